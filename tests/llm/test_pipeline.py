"""The pipeline against a version that does every stage plainly in Python."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from llm_cases import SF_SMALL
from test_decontaminate import template
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from panelkit.llm import bpe_prefix, cumulative_link, decontaminate, quality_ordinal


def brute(spark, sf_dir):
    read = lambda n: pq.read_table(f"{sf_dir}/{n}.parquet").to_pylist()
    docs = [(r["doc_id"], r["text"] or "") for r in read("documents")]
    # the model is the operator's (its training is tested elsewhere); the scoring is plain
    frame = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    model = quality_ordinal.fit(frame("documents"), frame("labels"))
    weight = model.weights.astype(np.float32)
    kept = []
    for i, t in docs:
        eta = sum(float(weight[cumulative_link.bucket(n)]) * v for n, v in quality_ordinal.units(t).items())
        if eta >= model.thresholds[0]:
            kept.append((i, t))
    best = {}
    for i, t in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, i, t)), (-len(t), i, t)) if key in best else (-len(t), i, t)
    kept = [(i, t) for _, i, t in best.values()]
    parts = brute_components([(i, brute_fingerprint(t)) for i, t in kept])
    kept = [(i, t) for (i, t), c in zip(kept, parts) if i == c]
    items = [template(r["text"]) for r in read("benchmark")]
    win = lambda w: [tuple(w[k:k + decontaminate.WINDOW]) for k in range(len(w) - decontaminate.WINDOW + 1)]
    clean = []
    for i, t in kept:
        seen = set(win(template(t)))
        share = [np.mean([a in seen or b in seen for a, b in zip(win(w), win(["<name>"] + w[1:]))]) for w in items]
        if max(share) < decontaminate.MIN_COVERAGE:
            clean.append((i, t))
    ranks = bpe_prefix.load_ranks(public_tokenizers.path(bpe_prefix.RANK_FILE))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = set()
    for i, t in clean:
        ids = enc.encode_ordinary(t)
        out.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_run_matches_brute_force(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = [tuple(r) for r in got.collect()]
    want = brute(spark, SF_SMALL)
    assert len(rows) == len(want) and set(rows) == want


def test_stages_handle_odd_rows_and_keep_extra_columns(spark, docs):
    df = docs([(1, None), (2, ""), (3, "plain words in a row"), (3, "plain words in a row"), (None, "a row without id")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (df, docs([])):
            out = stage(spark, table, SF_SMALL)
            assert out.columns == df.columns and out.count() <= table.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF_SMALL).count() == 5


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
