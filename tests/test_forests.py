"""Forests and trees fitted on counted rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelkit.operators import explain, forests, models
from panelkit.plans import modeling

COLS = ["a", "b", "c"]


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(models, "PLAIN_ROWS", 100)
    d = spark.range(4000).select(F.col("id"), F.pmod(F.hash("id"), F.lit(12)).cast("double").alias("a"),
                                 F.pmod(F.hash("id", F.lit(1)), F.lit(5)).cast("double").alias("b"), (F.col("id") % 2).cast("double").alias("c"))
    d = d.withColumn("y", F.col("a") + 3 * (F.col("b") > 2).cast("double") + F.pmod(F.hash("id", F.lit(2)), F.lit(100)) / 100)
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(d.withColumn("high", (F.col("y") > 8).cast("double")))


def test_counted_forest_predicts_as_mllib_does(spark, rows):
    est = models.learner("forest300", label="y", numTrees=60)
    m = models.fit(est, rows)
    assert isinstance(m, forests.CountedForest) and len(m.trees) == 60
    got = m.transform(rows).join(est.fit(rows).transform(rows).select("id", F.col("prediction").alias("plain")), "id").toPandas()
    assert np.corrcoef(got["prediction"], got["plain"])[0, 1] > 0.99
    assert abs((got["prediction"] - got["y"]).pow(2).mean() / (got["plain"] - got["y"]).pow(2).mean() - 1) < 0.15
    assert m.featureImportances.toArray() == pytest.approx(est.fit(rows).featureImportances.toArray(), abs=0.12)


def test_counted_trees_bag_rows(spark, rows):
    m = models.fit(models.learner("forest_classifier300", label="high", numTrees=40), rows)
    n = m.stats[:, 0].sum(axis=1)
    assert len(set(n)) > 1 and abs(n.mean() - 4000) < 5 * (4000 / 40) ** 0.5 and 20 < n.std() < 130  # Poisson(1) copies of every row
    for t, i in zip(*np.nonzero(m.feature >= 0)):
        assert m.stats[t, i].tolist() == (m.stats[t, 2 * i + 1] + m.stats[t, 2 * i + 2]).tolist()
    sc = m.transform(rows).withColumn("p", models.vector_to_array("probability")).toPandas()
    assert (sc["prediction"] == sc["high"]).mean() > 0.9 and sc["p"].map(sum).tolist() == pytest.approx([1.0] * 4000)
    by_tree = {}
    for r in m.node_rows():
        by_tree.setdefault(r[0], {})[r[1]] = r

    def walk(nodes, x):
        r = nodes[0]
        while r[2] >= 0:
            r = nodes[r[7] if x[r[2]] <= r[3] else r[8]]
        return r[6]

    some = sc.head(25)
    share = [np.mean([walk(nodes, x) for nodes in by_tree.values()]) for x in some[COLS].to_numpy()]
    assert all((s > 0.5) == p for s, p, q in zip(share, some["prediction"], some["p"]) if abs(s - 0.5) > 0.2)


def test_best_split_is_that_of_all_splits():
    rng = np.random.default_rng(1)
    hist = rng.integers(0, 9, (11, 2)).astype(float)
    start, best = np.array([0, 6, 8, 11]), None
    for f in range(3):
        h = hist[start[f]:start[f + 1]]
        gini = lambda s: 1 - ((s / s.sum()) ** 2).sum()
        for b in range(len(h) - 1):
            left, right = h[:b + 1].sum(axis=0), h[b + 1:].sum(axis=0)
            g = gini(h.sum(axis=0)) - (left.sum() * gini(left) + right.sum() * gini(right)) / h.sum()
            best = max(best or (g, f, b), (g, f, b))
    assert forests._best_split(hist, start, np.arange(3), 2)[:3] == pytest.approx(best)


def test_labels_that_mllib_refuses_stay_its_errors(rows):
    bad = rows.withColumn("y", F.when(F.col("id") != 7, F.col("y")))
    with pytest.raises(PySparkException):
        models.fit(models.learner("forest300", label="y", numTrees=3), bad)
    with pytest.raises(PySparkException):
        models.fit(models.learner("forest_classifier300", label="high", numTrees=3), rows.withColumn("high", F.col("high") - 1))


def test_rows_that_hardly_share_cells_are_left_to_mllib(rows, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_CELL", 1000)
    assert not isinstance(models.fit(models.learner("forest300", label="y", numTrees=3), rows), forests.CountedForest)


def test_surrogate_tree_of_counted_rows_has_the_rules_of_all_rows(spark, rows):
    est = models.learner("tree_classifier_d4", label="high")
    m = models.fit(est, rows)
    assert isinstance(m, models.BinnedTree)
    got, plain = (sorted(map(tuple, explain.surrogate_rules(spark, t, COLS).collect())) for t in (m, est.fit(rows)))
    assert got == plain


def test_partial_dependence_of_counted_rows_is_that_of_all(spark, rows, monkeypatch):
    raw = rows.select("id", "y", F.when(F.col("id") % 9 > 0, F.col("a") + F.col("id") % 7 / 10).alias("a"), "b",
                      F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.col("c").cast("string"))).alias("s"))
    prep = models.fit_prep(raw, ["a", "b"], ["s"])
    m = models.fit(models.learner("forest300", label="y", numTrees=20), prep.transform(raw).drop("a", "b", "s"))
    assert isinstance(m, forests.CountedForest)
    score, sizes = modeling._scorer(m, prep), []
    counted = score.counted
    score.counted = lambda *args: sizes.append(counted(*args).count()) or counted(*args)
    got, plain = (explain.pdp_ice(s, raw, "b", "id", by=["s"], points=5, sample_per_cell=None)[0].toPandas().sort_values(["s", "grid_index"])
                  for s in (score, lambda d: score(d)))
    assert sizes and sizes[0] <= 3 * 32  # levels x bins, of 4,000 rows
    assert got["partial_dependence"].to_numpy() == pytest.approx(plain["partial_dependence"].to_numpy(), rel=1e-12)
    assert got["s"].isna().sum() == 5 and list(got["grid_value"]) == list(plain["grid_value"])


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Orders with a price for every row and few levels elsewhere."""
    at, ids = tmp_path_factory.mktemp("shop"), spark.range(3000)
    pick = lambda seed, xs: F.element_at(F.array(*map(F.lit, xs)), F.pmod(F.hash("id", F.lit(seed)), F.lit(len(xs))) + 1)
    spark.range(60).select(F.col("id").alias("c_custkey"), (F.col("id") % 4 * 10.0).alias("c_acctbal"),
                           pick(1, ["BUILDING", "MACHINERY"]).alias("c_mktsegment")).write.parquet(f"{at}/customer.parquet")
    ids.select(F.col("id").alias("o_orderkey"), (F.col("id") % 60).alias("o_custkey"), (F.pmod(F.hash("id"), F.lit(100_000)) + 1.5).alias("o_totalprice"),
               pick(2, ["1-URGENT", "5-LOW"]).alias("o_orderpriority"), pick(3, ["F", "O"]).alias("o_orderstatus")).write.parquet(f"{at}/orders.parquet")
    return str(at)


@pytest.mark.parametrize("query", ["pdp_table", "surrogate_tree_rules", "counterfactual_changes", "counterfactual_frequency", "anchor_rules",
                                   "classifier_scores", "permutation_importance"])
def test_queries_grow_their_forests_on_counted_rows(spark, shop, monkeypatch, query):
    def refuse(*args):
        raise AssertionError("a forest of rows")

    monkeypatch.setattr(models, "PLAIN_ROWS", 100)
    monkeypatch.setattr(models, "ROWS_PER_CELL", 1)
    for cls in (models.RandomForestRegressor, models.RandomForestClassifier):
        monkeypatch.setattr(cls, "_fit", refuse)
    assert getattr(modeling, query)(spark, shop).count() > 0
