"""Permuted copies that travel packed."""

import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import explain, forests, models, permute, split
from panelkit.plans import modeling


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000, 10_007])
def test_tables_are_the_bijection_and_its_inverse(spark, n):
    combos = split.permutation_combos(spark, ["f"], 3, 5)
    got = split.with_bijection(spark.range(n).crossJoin(combos), "id", n, "__keys", "to").select("repeat", "id", "to").toPandas()
    for r, g in got.groupby("repeat"):
        b, g = permute.Bijection(n, split.bijection_keys(5, "f", r)), g.sort_values("id")
        assert b.to(b.digits(np.arange(n))).tolist() == g["to"].tolist()
        assert b.back(b.digits(g["to"].to_numpy())).tolist() == list(range(n))


@pytest.fixture
def rows(spark):
    """Doubles that are hundredths and others, nulls, NaN, strings, dates, decimals, a repeated and a null key."""
    d = spark.range(700).withColumn("k", F.when(F.col("id") != 5, F.greatest(F.col("id"), F.lit(3))))
    odd = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 13 == 0, F.lit(float("nan"))).when(F.col("id") % 17 == 0, F.lit(-0.0))
    return d.select("k", (F.col("id") / 100).alias("cents"), odd.otherwise(F.sqrt("id")).alias("odd"), F.when(F.col("id") % 7 > 0, F.col("id") % 9).alias("whole"),
                    F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("text"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day"),
                    (F.col("id") % 3).cast("decimal(5,2)").alias("amount"), (F.col("id") % 2 == 0).alias("flag"), F.lit(None).cast("string").alias("none"))


NAMES = ["cents", "odd", "whole", "text", "day", "amount", "flag", "none"]


def test_copies_are_those_of_the_bijection(spark, rows, monkeypatch):
    monkeypatch.setattr(permute, "BLOCK_ROWS", 100)
    monkeypatch.setattr(permute, "LEAST_ROWS", 1)
    rows = rows.where("k != 3 or k is null").withColumn("at", F.coalesce("k", F.lit(-1)))  # keys that name one row
    p = permute.permuted(rows, "k", NAMES, 2, 9)
    assert p.blocks.count() >= 7 and p.copies().schema.names == [*rows.columns, "__copy"]
    assert [f.dataType for f in p.copies().schema][:-1] == [f.dataType for f in rows.schema]
    own = [tuple(r) for r in rows.orderBy("k").collect()]
    got = {}
    for r in p.copies().collect():
        got.setdefault(r["__copy"], {})[r["at"]] = tuple(r)[:-1]
    n = len(own)
    assert sorted(got) == list(range(2 * len(NAMES) + 1)) and all(len(x) == n for x in got.values())
    show = lambda r: [repr(v) for v in r]
    for c, copy in got.items():
        j, want = c // 2, [list(r) for r in own]
        if j < len(NAMES):
            b = permute.Bijection(n, split.bijection_keys(9, NAMES[j], c % 2 + 1))
            for i, to in enumerate(b.to(b.digits(np.arange(n)))):
                want[to][j + 1] = own[i][j + 1]
        assert [show(copy[r[-1]]) for r in want] == [show(r) for r in want]
    assert isinstance(own[0][5], datetime.date) and isinstance(own[0][6], decimal.Decimal)


def _score(d):
    return d.withColumn("prediction", F.coalesce("cents", F.lit(0.0)) + F.coalesce("whole", F.lit(0)) + F.length(F.coalesce("text", F.lit(""))))


def test_packed_and_joined_importances_agree(spark, rows, monkeypatch):
    df = rows.where("k > 3").withColumn("y", F.when(F.col("k") % 10 > 0, F.col("cents") * 2))
    got = explain.permutation_importance(_score, df, "k", "y", NAMES, 4).toPandas().sort_values("feature")
    monkeypatch.setattr(permute, "LEVELS", 1)  # too many for codes
    want = explain.permutation_importance(_score, df, "k", "y", NAMES, 4).toPandas().sort_values("feature")
    assert list(got["feature"]) == list(want["feature"]) == sorted(NAMES)
    for c in ("importance_mean", "importance_sd"):
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-12)


def test_equal_and_null_keys_keep_every_row(spark, rows):
    p = permute.permuted(rows, "k", ["cents"], 3, 1)
    assert p.copies().groupBy("__copy").agg(F.count(F.lit(1)), F.round(F.sum("cents"), 6), F.count_distinct("cents")).distinct().count() == 4
    assert {tuple(r)[1:] for r in p.copies().groupBy("__copy").agg(F.count(F.lit(1)), F.round(F.sum("cents"), 6), F.count_distinct("cents")).collect()} == {(700, 2446.5, 700)}


def test_a_copy_sends_its_values_and_nothing_else(spark):
    n, repeats = 20_000, 10
    df = spark.range(n).select("id", (F.pmod(F.hash("id"), F.lit(10_000_000)) / 100).alias("price"), F.concat(F.lit("s"), F.col("id") % 5).alias("text"))
    p = permute.permuted(df, "id", ["price", "text"], repeats, 1)
    sent = permute._sent(p.blocks, p.columns, p.keys, p.size, p.n).where("from >= 0")
    assert sent.agg(F.sum(F.length("data"))).first()[0] <= n * repeats * (4 + 1) + 2 * sent.count()


def test_no_rows_and_no_known_target(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id long, a double, y double")
    score = lambda d: d.withColumn("prediction", F.col("a"))
    assert [tuple(r) for r in explain.permutation_importance(score, df, "id", "y", ["a"], 2).collect()] == [("a", None, None)]
    assert explain.permutation_importance(score, df.limit(0), "id", "y", ["a"], 2).count() in (0, 1)


def test_looked_up_importances_are_the_scored_ones(spark, monkeypatch):
    monkeypatch.setattr(models, "PLAIN_ROWS", 100)
    d = spark.range(3000).select("id", F.when(F.col("id") % 50 > 0, F.pmod(F.hash("id"), F.lit(97)) / 7).alias("a"), (F.pmod(F.hash("id", F.lit(1)), F.lit(3)) * 1.5).alias("b"),
                                 F.when(F.col("id") % 40 > 0, F.concat(F.lit("s"), F.pmod(F.hash("id", F.lit(2)), F.lit(3)))).alias("s"))
    d = d.withColumn("a", F.when(F.col("id") % 71 == 0, float("nan")).otherwise(F.col("a")))
    d = d.withColumn("y", F.coalesce(F.nanvl("a", F.lit(3.0)), F.lit(0.0)) + 2 * F.coalesce((F.col("s") == "s1").cast("double"), F.lit(0.0)))
    features = ["a", "b", "s"]
    known = d.where("not isnan(coalesce(a, 0))")
    prep = models.fit_prep(known.where("s != 's2' or s is null"), ["a", "b"], ["s"])  # s2 is a level unseen in training
    m = models.fit(models.learner("forest", label="y", numTrees=20), prep.transform(known))
    assert isinstance(m, forests.CountedForest)
    score = modeling._scorer(m, prep)
    coded, _, sizes, table = score.table(d, "y", features, "id")
    place = (F.col("a") * sizes[1] + F.col("b")) * sizes[2] + F.col("s")
    got = coded.select("id", place.alias("at")).join(score(d), "id").select("at", "prediction").collect()
    assert len(got) == 3000 and all(table[r["at"]] == r["prediction"] for r in got)
    test = d.withColumn("y", F.when(F.col("id") % 29 > 0, F.col("y")))
    looked, scored = (explain.permutation_importance(s, test, "id", "y", features, 5).toPandas().sort_values("feature") for s in (score, lambda x: score(x)))
    for c in ("importance_mean", "importance_sd"):
        assert looked[c].to_numpy() == pytest.approx(scored[c].to_numpy(), rel=1e-9, abs=1e-12)
    assert looked["importance_mean"].max() > 0.5
    calls = []
    quiet = lambda x: calls.append(1) or score(x)
    quiet.table = score.table
    assert explain.permutation_importance(quiet, test, "id", "y", features, 2).count() == 3 and not calls  # no copy is scored
    monkeypatch.setattr(modeling, "TABLE_CELLS", 10)
    assert score.table(d, "y", features, "id") is None and score.table(d, "y", ["a"], "id") is None
