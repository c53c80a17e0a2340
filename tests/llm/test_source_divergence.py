import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import LONG, SF_SMALL

from panelkit.llm import source_divergence as S

COLS = ["lang", "source", "part", "item", "value", "rank"]


def words_of(text):
    out, word = [], ""
    for ch in text + " ":
        if "A" <= ch <= "Z" or "a" <= ch <= "z" or ch >= "\x80":
            word += ch.lower() if ch <= "Z" else ch
        else:
            out += [word] if word else []
            word = ""
    return out


def brute(rows, min_docs=3, top=200):
    """The contract, dense: every group against every kept term."""
    out = []
    rows = [tuple(x or "" for x in r) for r in rows]
    for lang in {r[1] for r in rows}:
        mine = [(r[2], words_of(r[0])) for r in rows if r[1] == lang]
        df = Counter(t for _, w in mine for t in set(w))
        kept = [t for t in df if df[t] >= min_docs]
        count = {s: Counter() for s, _ in mine}
        for s, w in mine:
            count[s].update(t for t in w if df[t] >= min_docs)
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s in count:
            pairs = [(o, sum(f(p(count[s], t), p(count[o], t)) for t in kept)) for o in count if o != s]
            found = [(t, f(p(count[s], t), p(whole, t))) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", found, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("n", "sha", "term", "by", "p", "at", "value", "kept")})


def made(seed=3):
    rnd = random.Random(seed)
    vocab = ["The", "the", "café", "CAFÉ", "of", "x", "日本", "zeta", "Élan", "été"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(150):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 12))) + rnd.choice([".", "1", "", " a_b-c"])
        rows.append((text, rnd.choice(["en", "en", "fr", None, ""]), rnd.choice(["s1", "s2", "s3", "é", None])))
    copy = ("the same hot text of many rows", "en", "s1")
    return rows + [copy] * 60 + [(copy[0], "en", "s2")] * 5 + [(copy[0], "fr", "s9"), (None, "en", "empty"), ("", "xx", "a"), ("1 2", "xx", "b"), (LONG, "fr", "s1")]


@pytest.mark.parametrize("bounds", [{}, {"held": 5, "block": 2, "blocks": 3, "pairs": 4}])
def test_matches_brute_force(spark, bounds):
    rows = made()
    got = S.divergence(table(spark, rows), **bounds)
    assert got.columns == COLS
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(v == 0 for *_, v, _ in want) >= 2  # the language without kept terms


def test_only_the_best_terms(spark):
    rows = made(5)
    assert sorted(map(tuple, S.divergence(table(spark, rows), top=2).collect())) == brute(rows, top=2)


def test_term_counts(spark):
    rows = [("a a B", "en", "s")] * 3 + [("a a B", "en", "t"), ("b", "en", "t")]
    got = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in S.term_counts(table(spark, rows)).collect()}
    assert got == {("s", "a"): (6, 3), ("s", "b"): (3, 3), ("t", "a"): (2, 1), ("t", "b"): (2, 2)}


def test_long_texts_are_streamed(monkeypatch):
    text = ("Ab é 9x. " * 50).encode()
    whole = S.terms(text)
    monkeypatch.setattr(S, "LONG_TEXT", 10)
    assert S.terms(text) == whole == Counter({b"ab": 50, "é".encode(): 50, b"x": 50})


def test_pairs_of_entries_by_list():
    lens = np.array([2, 0, 1, 3])
    want = [(a, b) for lo, hi in ((0, 2), (2, 3), (3, 6)) for a in range(lo, hi) for b in range(lo, hi)]
    for most in (1, 4, 100):
        assert [(int(a), int(b)) for x, y in S._pairs(lens, most) for a, b in zip(x, y)] == want


def test_huge_counts_stay_exact(spark):
    n, total, v = 9_000_000_000_000, 9_100_000_000_000, 12_345
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    got = df.select(S.share(df["n"], df["total"], df["v"])).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + v)


def test_empty_table(spark):
    assert S.divergence(table(spark, [])).count() == 0


def test_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({S.ORACLE})").fetchall()
    assert sorted(want) == sorted(map(tuple, S.op12_source_divergence(spark, SF_SMALL).select(*COLS).collect()))
