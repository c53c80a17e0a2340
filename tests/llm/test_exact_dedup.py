import re

from llm_cases import LONG
from pyspark.sql import functions as F

from panelkit.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n"), (7, LONG), (8, LONG + " "), (9, "ab "),
        (None, "a\x0bb c"), (11, "abc"), (12, "A b"), (13, "é"), (14, "é"), (14, "é "), (-5, "ab")]


def check(got, rows):
    want = brute(rows)
    seen = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr)
    exp = sorted(((i, *want[re.sub(r"[\x20\x09-\x0D]", "", t or "")]) for i, t in rows), key=repr)
    assert seen == exp


def test_groups_match_brute_force(docs):
    got = X.exact_groups(docs(ROWS)).collect()
    check(got, ROWS)
    assert sum(r["kept"] for r in got) == len(brute(ROWS))


def test_collisions_of_the_short_hash_are_kept_apart(docs):
    got = X.exact_groups(docs(ROWS), hash128=lambda norm: F.unhex(F.lit("00"))).collect()
    check(got, ROWS)


def test_keep_rows_leaves_one_row_per_text_with_all_columns(docs):
    df = docs(ROWS + [(2, "ab"), (3, "a  b"), (3, "a  b")])
    kept = X.keep_rows(df)
    assert kept.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted(brute(ROWS))


def test_empty_table(docs):
    assert X.exact_groups(docs([])).count() == 0 and X.keep_rows(docs([])).count() == 0


def test_the_largest_id_is_an_id(docs):
    big = (1 << 63) - 1
    rows = [(big, "a"), (None, "a"), (big, "bb"), (5, "c"), (big, "c "), (None, "d")]
    got = {(r["doc_id"], r["group_size"]): (r["keep_id"], r["kept"]) for r in X.exact_groups(docs(rows)).collect()}
    assert got == {(big, 2): (big, True), (None, 2): (big, False), (big, 1): (big, True), (5, 2): (big, False), (None, 1): (None, True)}
