import re

import pyarrow.parquet as pq
from llm_cases import LONG, SF_MID

from panelkit.llm import decontaminate as D

ITEM = "Tom has 3 apples and gives 4 to Ann so Tom has 7."
ITEMS = [(10, ITEM), (11, "short one"), (12, None), (13, ""), (14, "The tower is 30 m tall and the bridge is 30 m long")]
ROWS = [
    (1, "yesterday Tom has 3 apples and gives 4 to Ann so Tom has 7"),  # verbatim
    (2, "so it goes. Bob has 5 apples and gives 2 to Sue so Bob has 9 ok"),  # other values
    (3, "x Bob has 5 apples and gives 2 to Sue so Jim has 9 ok y z more words here"),  # values that disagree
    (4, "tom has 3 apples and gives 4 to ann so tom has 7"),  # lower case
    (5, None), (6, ""), (7, "nothing at all here to see folks move along"), (8, "the short one is in here"),
    (None, "short one again"), (15, LONG),
    (16, "the tower is 45 km tall and the bridge is 45 km long"), (17, "the tower is 45 km tall and the bridge is 46 km long"),
    (18, "tower is 30 m"), (1, "another row of that id"),
]


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, start int, wh string")


def test_leaks(spark, docs):
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs(ROWS), items_of(spark)).collect()}
    assert set(got) == {(1, 10), (2, 10), (4, 10), (8, 11), (None, 11), (16, 14)}
    assert got[1, 10]["n_changed"] == 0 and got[1, 10]["coverage"] == 1
    assert got[2, 10]["n_changed"] == 5
    assert got[16, 14]["n_changed"] == 2


QUESTION = "Tom has 3 apples. Ann gives him 4 more apples. Tom eats 2 apples. How many apples does Tom have?"
EXCHANGED = [
    (1, "Some text. Bob has 5 apples. Sue gives him 6 more apples. Bob eats 1 apples. How many apples does Bob have?"),
    (2, "\u201cBob has 5 apples.  Sue gives him 6 more apples.\nBob eats 1 apples. (How many apples does Bob have?)\u201d"),
    (3, "and Bob has 5 apples. Sue gives him 6 more apples. Jim eats 1 apples. How many apples does Kim have?"),
    (4, "Bob likes 5 pears. Sue gives him 6 more pears. Bob sells 1 pear. How many pears does Bob want?"),
    (None, "Bob has 5 apples. Sue gives him 6 more apples. Bob eats 1 apples. How many apples does Bob have?"),
]


def test_names_that_open_sentences(spark, docs):
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs(EXCHANGED), items_of(spark, [(40, QUESTION)])).collect()}
    assert set(got) == {(1, 40), (2, 40), (None, 40)}
    for r in got.values():
        assert r["coverage"] == 1 and r["n_slots"] == 6 and r["n_changed"] == 5  # tom, ann, 3, 4, 2; "how" stays


STONE = "the old bridge is 30 m long and was built by hand from heavy grey stone over the wide cold river near " \
    "a small town where the tower is 30 m tall"


def test_slots_that_disagree_cost_their_windows_only(spark, docs):
    rows = [(1, "x Bob has 5 apples and gives 5 to Sue so Bob has 10"),  # two new values coincide
            (2, STONE.replace("30 m tall", "31 m tall")),  # a copy with one edited slot
            (3, "x Bob has 5 apples and gives 2 to Sue so Jim has 9"),
            (None, STONE.replace("30 m tall", "31 m tall"))]
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs(rows), items_of(spark, [(10, ITEM), (41, STONE)])).collect()}
    assert set(got) == {(1, 10), (2, 41), (None, 41)}
    assert got[1, 10]["coverage"] == 1 and got[1, 10]["n_changed"] == 5
    # 32 words are 28 windows; 8 of them hold a 30
    assert (got[2, 41]["n_windows"], got[2, 41]["n_covered"], got[2, 41]["n_changed"]) == (28, 20, 0)


def test_broadcast_bound_changes_nothing(spark, docs, monkeypatch):
    want = sorted(D.contaminated(docs(ROWS), items_of(spark)).collect(), key=repr)
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(D.contaminated(docs(ROWS), items_of(spark)).collect(), key=repr) == want


def test_clean_rows(spark, docs):
    df = docs(ROWS)
    kept = D.clean_rows(df, items_of(spark))
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [3, 5, 6, 7, 15, 17, 18]


def test_empty_tables(spark, docs):
    assert D.contaminated(docs([]), items_of(spark)).count() == 0
    assert D.contaminated(docs(ROWS), items_of(spark, [])).count() == 0
    assert D.clean_rows(docs(ROWS), items_of(spark, [])).count() == len(ROWS)


def template(text):
    """Words of a text as the module's docstring defines them."""
    out = []
    for m in re.finditer(r"[^\W_]+", text):
        w, before = m[0], text[max(0, m.start() - 2):m.start()]
        if w[0].isupper() and len(before) == 2 and re.match(r"[^\W_]|[,;)]", before[0]) and before[1] in " \t\n\x0b\x0c\r":
            out.append("<name>")
        elif w[0] in "0123456789":
            out.append("<num>")
        else:
            out.append("<unit>" if w.lower() in D.UNITS else w.lower())
    return out


def test_query_matches_brute_force(spark):
    """Items without placeholders: coverage of the windows is all there is."""
    items = pq.read_table(f"{SF_MID}/benchmark.parquet").to_pydict()
    table = pq.read_table(f"{SF_MID}/documents.parquet").to_pydict()
    win = lambda w: [tuple(w[i:i + D.WINDOW]) for i in range(len(w) - D.WINDOW + 1)]
    want, at = set(), {}
    sizes = {}
    for i, t in zip(items["item_id"], items["text"]):
        w = template(t)
        assert not {"<name>", "<num>", "<unit>"} & set(w) and len(w) >= D.WINDOW
        sizes[i] = len(win(w))
        for variant in (w, ["<name>"] + w[1:]):
            for k, x in enumerate(win(variant)):
                at.setdefault(x, set()).add((i, k))
    for d, t in zip(table["doc_id"], table["text"]):
        hit = {}
        for x in win(template(t or "")):
            for i, k in at.get(x, ()):
                hit.setdefault(i, set()).add(k)
        want |= {(d, i, len(k)) for i, k in hit.items() if len(k) >= D.MIN_COVERAGE * sizes[i]}
    got = {(r["doc_id"], r["item_id"], r["n_covered"]) for r in D.op1_decontaminate(spark, SF_MID).collect()}
    assert want and got == want


def test_short_items_and_placeholders_need_their_own_words(spark, docs):
    items = [(1, "42"), (2, "Yes"), (3, "Paris 1900"), (4, "7 8 9 10 11 12"), (5, "the 5 cats")]
    rows = [(1, "There were 7 cats."), (2, "call me in 2021 please"), (3, "Paris is big"), (4, "it is 42 or so"), (5, "well, yes"), (6, "in Paris 1900 was"),
            (7, "1 2 3 4 5 6 7"), (8, "6 7 8 9 10 11 12 13"), (9, "Rome 1900"), (10, "And the 9 cats left")]
    got = {(r["doc_id"], r["item_id"], r["n_changed"]) for r in D.contaminated(docs(rows), items_of(spark, items)).collect()}
    assert got == {(4, 1, 0), (5, 2, 0), (6, 3, 0), (8, 4, 0), (10, 5, 1)}


def sql_rows(rows, items):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    return sorted(con.execute(D.ORACLE).fetchall())


def test_oracle_matches_on_placeholders(spark, docs):
    # the SQL slices whole lists once per window, so without the very long text
    rows = [(i, t) for i, t in ROWS if i is not None and t not in ("another row of that id", LONG)] + [(30, "a B C D 5 kg"), (31, "x. A B C"),
                                                                                        (32, "as Kim has 8 apples and gives 1 to Lee so Kim has 2")]
    items = ITEMS + [(20, "a B C D 7 kg")]
    want = sql_rows(rows, items)
    got = D.contaminated(docs(rows), items_of(spark, items)).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) >= 6


def test_oracle_matches_on_names_slots_and_short_items(spark, docs):
    rows = [(50 + i, t) for i, (_, t) in enumerate(EXCHANGED)] + [
        (1, "x Bob has 5 apples and gives 5 to Sue so Bob has 10"), (2, STONE.replace("30 m tall", "31 m tall")),
        (3, "x Bob has 5 apples and gives 2 to Sue so Jim has 9"), (4, "It is 42. Yes, Paris 1900 was big"), (5, STONE.upper()), (6, STONE.title()), (7, "so " + QUESTION), (8, STONE + " " + QUESTION)]
    items = [(10, ITEM), (40, QUESTION), (41, STONE), (1, "42"), (2, "Yes"), (3, "Paris 1900"), (4, "Is Paris 1900 or 42")]
    want = sql_rows(rows, items)
    got = sorted(tuple(r) for r in D.contaminated(docs(rows), items_of(spark, items)).collect())
    assert got == want and len(want) >= 9


def test_oracle_matches_on_random_texts(spark, docs):
    import random

    rnd = random.Random(11)
    vocab = ["Tom", "Ann", "has", "gives", "3", "4", "17", "kg", "m", "apples", "to", "and", "so", "the", "Why", "is"]
    item = lambda: "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", ". ", ", "]) for _ in range(rnd.randrange(1, 14)))
    items = [(i, item()) for i in range(25)]

    def changed(text):
        return "".join(rnd.choice(vocab) + " " if rnd.random() < 0.12 else w for w in re.findall(r"\S+\s*", text))

    rows = [(i, item() + changed(rnd.choice(items)[1]) + item()) for i in range(120)]
    want = sql_rows(rows, items)
    got = sorted(tuple(r) for r in D.contaminated(docs(rows), items_of(spark, items)).collect())
    assert got == want and len(want) > 40 and sum(r[6] > 0 for r in want) > 3
