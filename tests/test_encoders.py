"""Ported encoder / label-mode / equal-response cases (FIXTURES.md 1.3-1.6)."""

import pytest
from pyspark.sql import functions as F

from panelkit.operators import encode, groups


def _one(spark, value, expr_fn, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr_fn("v").alias("o")).first()["o"]


def test_scenario_one_hot_order(spark):
    for i, s in enumerate(["3Spurig", "Spielstrasse", "Ueberland", "NeueMitte"]):
        vec = _one(spark, s, lambda c: encode.fixed_one_hot(c, encode.SCENARIO_LEVELS))
        assert vec == [1.0 if j == i else 0.0 for j in range(4)]
    with pytest.raises(Exception):
        _one(spark, "Highway", lambda c: encode.fixed_one_hot(c, encode.SCENARIO_LEVELS))


def test_intro_binary(spark):
    for v in ["ambiguous", "ambigious", "AMBIGUOUS"]:
        assert _one(spark, v, encode.intro_binary) == 0.0
    for v in ["BOASTING", "  boasting  "]:
        assert _one(spark, v, encode.intro_binary) == 1.0
    with pytest.raises(Exception):
        _one(spark, "neutral", encode.intro_binary)


@pytest.mark.parametrize("width,bad", [(4, "A5"), (5, "A6"), (6, None)])
def test_code_one_hot(spark, width, bad):
    for i in range(width):
        vec = _one(spark, f" A{i + 1} ", lambda c: encode.fixed_code_one_hot(c, width))
        assert vec.index(1.0) == i and sum(vec) == 1.0 and len(vec) == width
    if bad:
        with pytest.raises(Exception):
            _one(spark, bad, lambda c: encode.fixed_code_one_hot(c, width))


def test_licence_flag(spark):
    assert _one(spark, "Y", encode.yes_flag) == 1.0
    for v in ["N", "no", ""]:
        assert _one(spark, v, encode.yes_flag) == 0.0


def test_floor_label(spark):
    cases = {1.0: 0, 1.5: 0, 3.0: 2, 3.5: 2, 4.5: 3, 5.0: 4}
    df = spark.createDataFrame([(k,) for k in cases], "t double")
    out, classes = encode.label(df, "t", "floor")
    assert classes == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert {r["t"]: r["label"] for r in out.collect()} == cases


def test_separate_fractional(spark):
    vals = [1.0 + 0.5 * i for i in range(9)]
    df = spark.createDataFrame([(v,) for v in vals], "t double")
    out, classes = encode.label(df, "t", "separate_fractional")
    got = {r["t"]: r["label"] for r in out.collect()}
    assert got[1.5] == 1 and got[2.5] == 3 and got[4.5] == 7
    df2 = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (2.0,)], "t double")
    assert encode.observed_classes(df2, "t") == [1.0, 2.0]
    with pytest.raises(Exception):
        spark.createDataFrame([(9.0,)], "t double").select(encode.observed_label("t", [1.0, 2.0])).collect()
    with pytest.raises(ValueError):
        encode.label(df, "t", "bogus")


def _flagged(spark, rows):
    df = spark.createDataFrame(rows, "pid string, intro string, scen string, trust double")
    g = groups.equal_response_groups(df, ["pid", "intro", "scen"], "trust")
    return {r["pid"] for r in g.where("equal_response").collect()}


def test_equal_response_fixture(spark):
    p1 = [("P1", "ambiguous", "3Spurig", 3.0)] * 14 + [("P1", "ambiguous", "3Spurig", 4.0)] * 6
    p2 = [("P2", "ambiguous", "3Spurig", float(v)) for v in range(1, 6)]
    assert _flagged(spark, p1 + p2) == {"P1"}
    p1b = [("P1", "ambiguous", "3Spurig", float(v)) for v in range(1, 6)]
    assert _flagged(spark, p1b + p2) == set()


@pytest.mark.parametrize("counts,expected", [
    ((10, 10), True), ((8, 7), True), ((9, 7), False), ((13, 7), False), ((13, 6), False),
    ((14, 1), True), ((14, 7), True), ((12, 9, 8), True), ((14,), True), ((7,), False)])
def test_equal_response_rule(spark, counts, expected):
    rows = []
    for v, c in enumerate(counts):
        rows += [("X", "a", "s", float(v + 1))] * c
    assert (_flagged(spark, rows) == {"X"}) is expected


def test_split_equal_response_is_partition(spark):
    rows = [("P1", "a", "s", 3.0)] * 14 + [("P2", "a", "s", float(v)) for v in range(1, 6)]
    df = spark.createDataFrame(rows, "pid string, intro string, scen string, trust double")
    eq, other = groups.split_equal_response(df, ["pid", "intro", "scen"], "trust")
    assert eq.count() == 14 and other.count() == 5
    assert eq.select("pid").distinct().collect()[0]["pid"] == "P1"
    assert set(eq.columns) == set(df.columns)


def test_quantile_unpivot_checks_length(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [0.4, 0.5, 0.6])], "id int, q array<double>")
    long = encode.unpivot_quantiles(df, "q", [0.25, 0.5, 0.75], keep=["id"])
    assert long.count() == 6
    assert long.where((F.col("id") == 2) & (F.col("quantile") == 0.75)).first()["prediction"] == 0.6
    with pytest.raises(Exception):
        encode.unpivot_quantiles(df, "q", [0.5], keep=["id"]).collect()
