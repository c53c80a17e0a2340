"""Keyed bijections: permutations of any size, equal to their SQL, well mixed."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import explain, split


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 10_007])
def test_every_number_once_and_equal_to_sql(spark, n):
    combos = split.permutation_combos(spark, ["f", "g"], 2, 5)
    df = spark.range(n).crossJoin(combos)
    got = split.with_bijection(df, "id", n, "__keys", "to").select("feature", "repeat", "id", "to").toPandas()
    for _, g in got.groupby(["feature", "repeat"]):
        assert sorted(g["to"]) == list(range(n))
    con = duckdb.connect()
    for (f, r), g in got.groupby(["feature", "repeat"]):
        sql = split.bijection_sql("i", "n", f"{split.bijection_keys(5, f, int(r))}::BIGINT[]")
        want = dict(con.execute(f"SELECT i, {sql} FROM (SELECT i, {n}::BIGINT AS n FROM range({n}) t(i))").fetchall())
        assert want == dict(zip(g["id"], g["to"]))


def test_no_trace_of_the_order_is_left(spark):
    n = 20_000
    combos = split.permutation_combos(spark, ["f"], 20, 1)
    got = split.with_bijection(spark.range(n).crossJoin(combos), "id", n, "__keys", "to").toPandas()
    fixed = []
    for _, g in got.groupby("repeat"):
        g = g.sort_values("id")
        to = g["to"].to_numpy()
        assert abs(np.corrcoef(g["id"], to)[0, 1]) < 0.03
        assert abs(np.corrcoef(to[:-1], to[1:])[0, 1]) < 0.03
        fixed.append(int((g["id"] == g["to"]).sum()))
    assert 5 < sum(fixed) < 45  # about one fixed point each
    wide = got.pivot(index="id", columns="repeat", values="to").to_numpy()
    c = np.corrcoef(wide.T) - np.eye(20)
    assert np.abs(c).max() < 0.04


def test_permutation_map_is_a_permutation(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(211)], "key string, v int")
    m = split.permutation_map(df, "key", ["a", "b"], 3, seed=4).toPandas()
    assert len(m) == 6 * 211
    for _, g in m.groupby(["feature", "repeat"]):
        assert sorted(g["key"]) == sorted(g["source_key"]) == sorted(f"k{i}" for i in range(211))
    assert len({tuple(g.sort_values("key")["source_key"]) for _, g in m.groupby(["feature", "repeat"])}) == 6


def test_importance_of_used_and_unused_features(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), None if i % 50 == 0 else "xy"[i % 2], float(2 * a)) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y double")
    imp = explain.permutation_importance(lambda d: d.withColumn("prediction", 2 * F.col("a") + 0 * F.length(F.coalesce("c", F.lit("")))),
                                         df, "id", "y", ["a", "b", "c"], repeats=10).toPandas().set_index("feature")
    assert abs(imp.loc["a", "importance_mean"] - 2 * 2 / np.sqrt(np.pi)) < 0.15  # E|2 (a - a')|
    assert imp.loc["b", "importance_mean"] == 0 and imp.loc["c", "importance_mean"] == 0


def test_one_numbering_serves_all_copies(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "id long, a double")
    out = explain.permutation_importance(lambda d: d.withColumn("prediction", F.col("a")), df.withColumn("y", F.col("a")), "id", "y", ["a"], 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [feature" not in plan
