import random

import xxhash
from llm_cases import LONG, SF_MID

from panelkit.llm import simhash_bk as H
from panelkit.llm.components import connected_components


def brute_fingerprint(text):
    words, w = [], b""
    for b in text.encode():
        if b == 0x20 or 9 <= b <= 13:
            words, w = words + [w] * bool(w), b""
        else:
            w += bytes([b + 32 if 65 <= b <= 90 else b])
    words += [w] * bool(w)
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: list of (id, fp) -> component of every position."""
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= H.RADIUS:
                up[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for _, f in fps]


def test_fingerprints(texts):
    odd = ["", " \n", "One", "One TWO", "one two three", "É a\x0bb\x0cc\x1cd e", "x " * 5, "a b c a b c a b c"]
    for t in texts[:120] + odd:
        assert H.fingerprint(t) == brute_fingerprint(t)
    assert H.fingerprint(LONG) == H.fingerprint("LOREM ipsum\tdolor " * 40_000) != 0


def test_bit_blocks_of_long_texts_add_up(monkeypatch, texts):
    want = [H.fingerprint(t) for t in texts[:20]]
    monkeypatch.setattr(H, "BITS_AT_ONCE", 7)
    assert [H.fingerprint(t) for t in texts[:20]] == want


def nodes_of(spark, fps):
    return spark.createDataFrame([(H.signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")


def cloud(rng, centres, each, far):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            f = c
            for b in rng.sample(range(64), rng.randint(0, far)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def test_links_join_what_brute_force_joins(spark):
    rng = random.Random(7)
    fps = cloud(rng, 40, 12, 4) + [0, 1, 7, (1 << 64) - 1]
    for shard in (4096, 5):  # 5: every dense bucket is salted
        links = H.near_links(nodes_of(spark, fps), shard=shard)
        got = {r["node"]: r["component"] for r in connected_components(links).collect()}
        want = brute_components(list(enumerate(fps)))
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_a_dense_bucket_sends_few_links(spark):
    fps = [0xABCDEF0123456789 ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24, 48)]
    links = H.near_links(nodes_of(spark, fps), shard=100).count()
    assert links < 40 * len(fps)  # all pairs within the radius: many times more


def test_tree_follows_only_edges_within_the_radius():
    rng, tree = random.Random(3), H.BKTree(3)
    keys = cloud(rng, 10, 20, 6)
    for k in keys:
        tree.add(k)
    for q in keys[:50] + [rng.getrandbits(64) for _ in range(20)]:
        assert sorted(tree.keys[i] for i in tree.near(q)) == [k for k in keys if (k ^ q).bit_count() <= 3]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(500, 700)] + [(3, 3), (9, 8), (8, 9)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(500, 700)}, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_table(docs, texts):
    base = texts[0] + " end of it"
    rows = [(i, t) for i, t in enumerate(texts[:150])] + [(900, base), (901, base), (902, base.upper()), (903, None), (904, ""),
                                                         (905, " "), (None, base), (None, "only without id"), (906, LONG), (906, LONG)]
    got = H.near_groups(docs(rows)).collect()
    fps = [(i, brute_fingerprint(t or "") if t != LONG else H.fingerprint(t)) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_keep_first(docs, texts):
    df = docs([(5, texts[0]), (3, texts[0]), (3, texts[0]), (8, texts[1]), (None, "lonely row without an id"), (9, None), (10, "")])
    kept = H.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [3, 8, 9, None]
    assert H.keep_first(docs([])).count() == 0 and H.near_groups(docs([])).count() == 0


def test_query_matches_brute_force(spark):
    got = H.op2_simhash_bk(spark, SF_MID).collect()
    fps = [(r["doc_id"], int(r["fingerprint"], 16)) for r in got]
    assert [r["component_id"] for r in got] == brute_components(fps)


def test_rows_without_an_id_connect_others(spark):
    """Fingerprints 0, 7 and 0x3f: the middle one is held by a null id only."""
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(1, 0), (None, 7), (2, 0x3F), (None, 0xFFFF << 40)], "id long, fp long")
    real = H.fingerprints
    H.fingerprints = lambda docs, *a, **k: nodes
    try:
        got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in H.near_groups(spark.range(1).withColumn("text", F.lit("")), "doc_id").collect()}
    finally:
        H.fingerprints = real
    assert got == {(1, "0" * 16): 1, (None, f"{7:016x}"): 1, (2, f"{0x3f:016x}"): 1, (None, f"{0xFFFF << 40:016x}"): None}
