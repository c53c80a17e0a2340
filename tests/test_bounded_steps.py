"""Steps whose memory or time must not follow the rows: joins that are not
broadcast, rows cut before a shuffle, equal rows counted before they are used."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelkit.operators import explain, models, split


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_draws_are_not_broadcast(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    d = split.bootstrap_draws(df, "k", ["g"], 5, seed=3)
    n = {(r["g"], r["b"]): r["count"] for r in d.groupBy("g", "b").count().collect()}
    assert n == {(g, b): 134 if g == 0 else 133 for g in range(3) for b in range(1, 6)}
    d.collect()
    assert any("SortMergeJoin" in x and "__idx" in x for x in _plan(d).splitlines())


@pytest.mark.parametrize("n", [5, 1500])
def test_sample_n_cuts_groups_before_the_shuffle(spark, n):
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"))
    s = split.sample_n(df, n, "k", by=["g"], seed=3)
    got = {(r["g"], r["k"]) for r in s.collect()}
    u = df.where("g is not null").withColumn("u", split.portable_uniform(F.lit(3), F.col("k"))).toPandas().sort_values(["u", "k"])
    assert got == set(u.groupby("g").head(n)[["g", "k"]].itertuples(index=False, name=None))
    assert n > split.GROUP_LIMIT or "WindowGroupLimit" in _plan(s) and "Join" not in _plan(s)


def test_mixture_quantiles_by_lists_as_by_join(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(t, leaf, float(v), rng.random()) for t in range(4) for leaf in range(5) for v in rng.sample(range(30), 6)] + [(0, 0, None, 0.3)]
    table = spark.createDataFrame(rows, "tree int, leaf int, value double, weight double")
    leaves = spark.createDataFrame([(None if k == 7 else k % 50, t, rng.randrange(7)) for k in range(60) for t in range(5)], "k long, tree int, leaf int")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    short = models.mixture_quantiles(leaves, table, "k", qs)
    a = {r["k"]: r["qpred"] for r in short.collect()}
    assert "Window" not in _plan(short)  # no row per (key, value)
    monkeypatch.setattr(models, "BROADCAST_ROWS", 0)
    assert a == {r["k"]: r["qpred"] for r in models.mixture_quantiles(leaves, table, "k", qs).collect()}


def test_leaf_table_counts_grid_values(spark):
    df = spark.range(600).select((F.col("id") * 0.5).alias("y"), array_to_vector(F.array(F.col("id") % 7 + 0.0)).alias("features"))
    m = models.learner("forest", label="y", numTrees=3, maxDepth=2).fit(df)
    t = models.leaf_table(m, df, "y", grid=20)
    assert "__y" not in "".join(x for x in _plan(t).splitlines() if "HashAggregate" in x)  # not one row per response
    assert {r["s"] for r in t.groupBy("tree", "leaf").agg(F.round(F.sum("weight"), 9).alias("s")).collect()} == {1.0}


def test_patterns_of_short_paths_need_no_sort(monkeypatch):
    tree = ([1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0, -1, 1, -1, -1], [0.0] * 5, [None] * 5, [0.0, 1.0, 0.0, 2.0, 5.0], [10.0, 4.0, 6.0, 1.0, 5.0], 1.0)
    monkeypatch.setattr(explain.np, "unique", lambda *a, **k: pytest.fail("rows are sorted"))
    x = np.array([[-1.0, 3.0], [1.0, -1.0], [1.0, 1.0]])
    phi = explain.tree_shap(x, [tree], 2)
    assert np.allclose(phi.sum(axis=1) + explain.expected_value([tree]), [1.0, 2.0, 5.0])


@pytest.mark.parametrize("weight", [None, "w"])
def test_boosting_on_counted_rows_as_on_rows(spark, weight, monkeypatch):
    monkeypatch.setattr(models, "PLAIN_ROWS", 0)
    rng = np.random.default_rng(5)
    rows = [([float(a), float(rng.integers(0, 3)), float(rng.integers(0, 2))], float(rng.integers(1, 3))) for a in rng.normal(size=150) for _ in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, x array<double>, w double").select(
        "id", "x", "w", array_to_vector("x").alias("features"), F.expr("sin(3 * x[0]) + x[1] * x[2] + 0.01 * (id % 3) + 0.05 * x[0] * x[1]").alias("y")).cache()
    est = GBTRegressor(maxIter=4, maxDepth=3, seed=1, labelCol="y")
    plain = (est.copy()._set(weightCol=weight) if weight else est).fit(df)
    m = models.fit(est, df, weight)
    assert isinstance(m, models.BinnedBoost)
    p, q = (np.array([r["prediction"] for r in x.transform(df).orderBy("id").select("prediction").collect()]) for x in (plain, m))
    assert np.allclose(p, q, atol=1e-9)
    assert np.allclose(plain.featureImportances.toArray(), m.featureImportances.toArray(), atol=1e-9)
    sh = explain.shapley(df, models.node_table(spark, m), "id").groupBy("id").agg((F.sum("shap") + F.first("expected_value")).alias("s"))
    assert np.allclose([r["s"] for r in sh.orderBy("id").collect()], q, atol=1e-9)
    assert max(float(t._java_obj.rootNode().impurityStats().count()) for t in m.trees) == (sum(r[1] for r in rows) if weight else len(rows))


def test_fixed_vectors_are_counted_before_they_are_taken_apart(spark, tmp_path):
    from panelkit.plans.encoding import fixed_vocab_vector

    spark.range(300).select(
        F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey"),
        (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 30 + 0.0).alias("l_quantity"), F.lit(7.5).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = fixed_vocab_vector(spark, str(tmp_path))
    got = {r["pos"]: (r["total"], r["n"]) for r in out.collect()}
    assert {n for _, n in got.values()} == {300} and sum(got[p][0] for p in range(1, 5)) == 300
    assert "keys=[features" in _plan(out)
