"""Cumulative-link models: gradient, recovery, held-out accuracy, tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_cases import LONG

from panelkit.llm import cumulative_link as M
from panelkit.llm import quality_ordinal as Q
from panelkit.llm import toxicity_ordinal as T

SF = "/root/testdata/sf0.1"


def toy(rng, n=400, d=6):
    x = rng.normal(size=(n, d))
    w = rng.normal(size=d)
    z = x @ w + rng.logistic(size=n)
    return x, np.digitize(z, [-1.0, 0.5, 2.0]), w


def entries(x):
    row, ids = np.nonzero(x)
    return row, ids, x[row, ids]


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    x, y, _ = toy(rng)
    p = np.concatenate((rng.normal(size=6), [-0.7, 0.1, -0.3]))
    fun = lambda q: M.loss_gradient(q, *entries(x), y, 4, 1e-2)
    _, g = fun(p)
    for j in range(len(p)):
        e = np.zeros(len(p))
        e[j] = 1e-6
        assert abs((fun(p + e)[0] - fun(p - e)[0]) / 2e-6 - g[j]) < 1e-6


def test_fit_recovers_weights_and_ordered_thresholds():
    rng = np.random.default_rng(2)
    x, y, w = toy(rng, 6000)
    rows = [(int(g), np.arange(6), v) for g, v in zip(y, x)]
    m = M.fit_rows(rows, 4, l2=1e-6, min_rows=1)
    assert np.abs(m.weights[:6] - w).max() < 0.15 and np.abs(m.thresholds - [-1, 0.5, 2]).max() < 0.15
    t = M.tails(np.linspace(-5, 5, 11), m.thresholds)
    assert (np.diff(t, axis=1) <= 0).all() and (np.diff(t, axis=0) >= 0).all()


def _labelled():
    d = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    text = dict(zip(d["doc_id"], d["text"]))
    lab = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    return [(text[i] or "", q, t) for i, q, t in zip(lab["doc_id"], lab["quality"], lab["toxic"]) if i in text]


@pytest.fixture(scope="module")
def labelled():
    return _labelled()


def _rows(sample, features, grade):
    out = []
    for text, q, t in sample:
        h = M.hashed(text, features)
        out.append((grade(q, t), np.array(list(h), np.int64), np.array(list(h.values()))))
    return out


def _positive(model, features, texts):
    scorer = M.Scorer(model.weights, features)
    return M.tails([scorer.eta(t) for t in texts], model.thresholds)[:, 0] >= 0.5


def test_toxicity_on_held_out_rows(labelled):
    test = labelled[::4]
    train = [x for i, x in enumerate(labelled) if i % 4]  # nearer to the size of the production sample
    m = M.fit_rows(_rows(train, T.FEATURES, lambda q, t: t * (2 - q)), 3)
    got, want = _positive(m, T.FEATURES, [x for x, _, _ in test]), np.array([t for _, _, t in test]) == 1
    assert (got & want).sum() / want.sum() > 0.8  # one label in ten marks a text without any toxic word
    assert (got & ~want).sum() / (~want).sum() < 0.02


def test_quality_on_held_out_rows(labelled):
    train, test = labelled[::2], labelled[1::2]
    m = M.fit_rows(_rows(train, Q.FEATURES, lambda q, t: 2 * q - q * t), 3, Q.L2)
    got, want = _positive(m, Q.FEATURES, [x for x, _, _ in test]), np.array([q for _, q, _ in test]) == 1
    assert (got & want).sum() / want.sum() > 0.99
    assert (~got & ~want).sum() / (~want).sum() > 0.94


def test_scorer_equals_the_hashed_product(labelled):
    rng = np.random.default_rng(0)
    w = rng.normal(size=M.DIM)
    for f in (T.FEATURES, Q.FEATURES):
        s = M.Scorer(w, f)
        for text, _, _ in labelled[:40]:
            assert s.eta(text) == pytest.approx(sum(w[b] * v for b, v in M.hashed(text, f).items()))


ROWS = [(1, "good words here and there"), (2, None), (3, ""), (4, LONG), (None, "a b c"), (1, "good words here and there")]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_sample_is_bounded_and_skips_nulls(spark, docs):
    lab = labels_of(spark, [(1, 1, 0), (2, 0, None), (3, 0, 1), (4, None, 0), (None, 1, 1), (3, 1, 0), (77, 1, 1)])
    got = M.labelled_features(docs(ROWS), Q.grades(lab), "doc_id", "text", Q.FEATURES)
    assert [g for g, _, _ in got] == [2, 0, 2]  # ids 1, 2 and 3 (the higher of two grades)
    assert len(M.labelled_features(docs(ROWS), Q.grades(lab), "doc_id", "text", Q.FEATURES, 1)) <= 1


def test_tables_without_labels(spark, docs):
    none = labels_of(spark, [])
    df = docs(ROWS)
    q = Q.score(df, Q.fit(df, none)).collect()
    assert len(q) == len(ROWS) and all(r["selected"] and r["p_tail"] is None for r in q)
    t = T.score(df, T.fit(df, none)).collect()
    assert len(t) == len(ROWS) and not any(r["toxic"] for r in t) and t[0]["severity"] is None


def test_tables_with_labels(spark, docs):
    junk = [(100 + i, "%%% ### " * 20 + str(i)) for i in range(40)]
    good = [(200 + i, f"some plain words number {i} in order") for i in range(40)]
    df = docs(ROWS + junk + good)
    model = Q.fit(df, labels_of(spark, [(i, 0, 0) for i, _ in junk[:30]] + [(i, 1, 0) for i, _ in good[:30]]))
    kept = Q.selected_rows(df, model)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and not ids & {i for i, _ in junk} and ids >= {i for i, _ in good}
    assert Q.score(df, model).count() == len(ROWS) + 80
    assert Q.score(docs([]), model).count() == 0 and Q.selected_rows(docs([]), model).count() == 0
    assert T.score(docs([]), model).count() == 0
