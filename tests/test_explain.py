"""Tree Shapley values vs brute-force Shapley over feature subsets."""

import itertools
import math
import random

import numpy as np
import pytest

from panelkit.operators.explain import expected_value, tree_interactions, tree_shap


def _random_tree(rng, n_feat, depth):
    left, right, feat, thr, cats, val, cover = [], [], [], [], [], [], []

    def build(d, c):
        i = len(left)
        left.append(-1); right.append(-1); feat.append(-1); thr.append(float("nan")); cats.append(None)
        val.append(rng.uniform(-2, 2)); cover.append(c)
        if d < depth:
            f = rng.randrange(n_feat)
            feat[i], thr[i] = f, rng.uniform(-1, 1)
            if f == 0:  # feature 0 is categorical with codes 0, 1, 2
                cats[i] = np.array(sorted(rng.sample([0.0, 1.0, 2.0], rng.randint(1, 2))))
            cl = c * rng.uniform(0.2, 0.8)
            left[i] = build(d + 1, cl)
            right[i] = build(d + 1, c - cl)
        return i

    build(0, 100.0)
    return (left, right, feat, thr, cats, val, cover, 0.7)


def _v(tree, x, S, j=0):
    left, right, feat, thr, cats, val, cover, wt = tree
    if left[j] < 0:
        return val[j] * wt
    if feat[j] in S:
        goes = x[feat[j]] in cats[j] if cats[j] is not None else x[feat[j]] <= thr[j]
        return _v(tree, x, S, left[j] if goes else right[j])
    return (cover[left[j]] * _v(tree, x, S, left[j]) + cover[right[j]] * _v(tree, x, S, right[j])) / cover[j]


def _brute(tree, x, m):
    phi = [0.0] * m
    for i in range(m):
        others = [f for f in range(m) if f != i]
        for k in range(len(others) + 1):
            for S in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[i] += w * (_v(tree, x, set(S) | {i}) - _v(tree, x, set(S)))
    return phi


def _brute_inter(tree, x, m, i, j):
    others = [f for f in range(m) if f not in (i, j)]
    tot = 0.0
    for k in range(len(others) + 1):
        for S in itertools.combinations(others, k):
            S = set(S)
            w = math.factorial(k) * math.factorial(m - k - 2) / (2 * math.factorial(m - 1))
            tot += w * (_v(tree, x, S | {i, j}) - _v(tree, x, S | {i}) - _v(tree, x, S | {j}) + _v(tree, x, S))
    return tot


def _rows(rng, m, n):
    return np.array([[float(rng.randrange(3))] + [rng.uniform(-1, 1) for _ in range(m - 1)] for _ in range(n)])


def test_tree_shap_matches_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        m = rng.randint(2, 5)
        trees = [_random_tree(rng, m, rng.randint(0, 4)) for _ in range(2)]
        x = _rows(rng, m, 6)
        phi = tree_shap(x, trees, m)
        for r, got in zip(x, phi):
            want = np.sum([_brute(t, r, m) for t in trees], axis=0)
            assert np.abs(got - want).max() < 1e-9
            assert abs(got.sum() + expected_value(trees) - sum(_v(t, r, set(range(m))) for t in trees)) < 1e-9


def test_interactions_match_brute_force():
    rng = random.Random(5)
    for _ in range(10):
        m = rng.randint(2, 4)
        tree = _random_tree(rng, m, rng.randint(2, 4))
        x = _rows(rng, m, 5)
        got = tree_interactions(x, [tree])
        for i in range(m):
            for j in range(i + 1, m):
                for k, r in enumerate(x):
                    have = got[i, j][k] if (i, j) in got else 0.0
                    assert abs(have - _brute_inter(tree, r, m, i, j)) < 1e-9


@pytest.fixture(scope="module")
def codes_model(spark):
    from pyspark.ml.feature import VectorAssembler, StringIndexer
    from pyspark.ml.regression import GBTRegressor
    from pyspark.sql import functions as F

    df = spark.range(600).select(
        "id", F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.col("id") % 4 + 1).cast("int")).alias("c"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("v"))
    df = df.withColumn("y", F.when(F.col("c").isin("a", "c"), 8.0).otherwise(1.0) + F.col("v") * F.when(F.col("c") == "b", 2).otherwise(0.3))
    df = StringIndexer(inputCol="c", outputCol="code").fit(df).transform(df)
    df = VectorAssembler(inputCols=["code", "v"], outputCol="features").transform(df)
    return GBTRegressor(labelCol="y", maxIter=15, maxDepth=3, seed=1).fit(df), df


def test_additivity_with_categorical_splits(spark, codes_model):
    from pyspark.sql import functions as F

    from panelkit.operators import explain, models

    model, df = codes_model
    nodes = models.node_table(spark, model)
    assert nodes.where("left_categories IS NOT NULL").count() > 0
    sh = explain.shapley(df, nodes, "id", feature_names=["code", "v"])
    tot = sh.groupBy("id").agg((F.sum("shap") + F.first("expected_value")).alias("s"))
    gap = tot.join(model.transform(df).select("id", "prediction"), "id").agg(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0]
    assert gap < 1e-9


def test_rule_text_names_the_categories(spark, codes_model):
    from pyspark.ml.classification import DecisionTreeClassifier

    from panelkit.operators import explain

    _, df = codes_model
    tree = DecisionTreeClassifier(labelCol="k", maxDepth=2, seed=1).fit(df.selectExpr("*", "cast(c in ('a','c') as double) as k"))
    rules = [r["rule"] for r in explain.surrogate_rules(spark, tree, ["code", "v"]).collect()]
    assert any("code IN (" in r for r in rules) and not any("nan" in r for r in rules)
