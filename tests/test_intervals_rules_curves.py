"""Leaf distributions (K8), local rules (L9), binned curves (L7), forward
selection (M5) and cut points (E4, E9)."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from panelkit.operators import equations, explain, models, ranks, smooth


def test_interval_covers_half_of_held_out_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 9000)
    y = 3 * x + (0.2 + x) * rng.normal(size=9000)  # the spread grows with x
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(pd.DataFrame({"id": np.arange(9000), "x": x, "y": y})))
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    m = RandomForestRegressor(numTrees=30, maxDepth=5, seed=1, labelCol="y").fit(train)
    table = models.leaf_table(m, train, "y", grid=150)
    assert table.count() <= 30 * 32 * 151
    sums = table.groupBy("tree", "leaf").agg(F.sum("weight").alias("w")).toPandas()
    assert np.allclose(sums["w"], 1)
    q = models.forest_quantiles(m, test, table, "id", [0.05, 0.25, 0.75, 0.95]).toPandas()
    lo, a, b, hi = np.array(q["qpred"].tolist()).T
    assert 0.45 < np.mean((q.y >= a) & (q.y <= b)) < 0.55
    assert 0.85 < np.mean((q.y >= lo) & (q.y <= hi)) < 0.95
    wide = (b - a)
    assert wide[q.x > 0.8].mean() > 2 * wide[q.x < 0.2].mean()  # the spread of the response, not of the tree means


def test_mixture_is_read_from_its_leaves(spark, monkeypatch):
    rows = [(0, 0, 1.0), (0, 0, 1.0), (0, 0, 3.0), (0, 0, 4.0), (0, 1, 9.0), (1, 0, 2.0), (1, 0, 4.0), (1, 0, None)]
    table = models.leaf_weights(spark.createDataFrame(rows, "tree int, leaf int, v double"), "v")
    leaves = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 0, 1), ("b", 1, 0)], "id string, tree int, leaf int")
    # a: 1 -> 1/4, 2 -> 1/4, 3 -> 1/8, 4 -> 3/8; b: 2, 4 -> 1/4 each, 9 -> 1/2
    want = {"a": [1.0, 2.0, 3.0, 4.0], "b": [2.0, 4.0, 9.0, 9.0]}
    for bound in (models.BROADCAST_ROWS, 0):
        monkeypatch.setattr(models, "BROADCAST_ROWS", bound)
        got = {r["id"]: r["qpred"] for r in models.mixture_quantiles(leaves, table, "id", [0.25, 0.5, 0.6, 0.9]).collect()}
        assert got == want


def _rules_by_hand(pdf, numeric, categorical, explained, precision_min, max_terms):
    preds = {}
    for c in numeric:
        c1, c2, c3 = np.quantile(pdf[c].dropna(), [0.25, 0.5, 0.75])
        preds[c] = [f"{c} is null" if pd.isna(v) else f"{c} <= {c1:g}" if v <= c1 else f"{c1:g} < {c} <= {c2:g}" if v <= c2
                    else f"{c2:g} < {c} <= {c3:g}" if v <= c3 else f"{c} > {c3:g}" for v in pdf[c]]
    for c in categorical:
        preds[c] = [f"{c} is null" if v is None else f"{c} = {v}" for v in pdf[c]]
    P = pd.DataFrame(preds)[numeric + categorical]
    sets = [s for k in range(1, max_terms + 1) for s in itertools.combinations(range(P.shape[1]), k)]
    out = {}
    for i in explained:
        best = None
        for n, s in enumerate(sets):
            cover = np.logical_and.reduce([P.iloc[:, j] == P.iloc[i, j] for j in s])
            prec, cov = (pdf.prediction[cover] == pdf.prediction[i]).mean(), cover.mean()
            ok = prec >= precision_min
            rank = (not ok, -cov if ok else 0, -prec, len(s), n)
            if best is None or rank < best[0]:
                best = (rank, " AND ".join(P.iloc[i, j] for j in s), prec, cov)
        out[i] = (f"IF {best[1]} THEN {pdf.prediction[i]}", round(best[2], 9), round(best[3], 9))
    return out


def test_local_rules_match_enumeration(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 12, n).astype(float), "b": rng.normal(size=n).round(1),
                        "c": rng.choice(["u", "v", "w"], n).astype(object), "d": rng.choice(["p", "q"], n).astype(object)})
    pdf["prediction"] = ((pdf.a > 6) & (pdf.c != "w")).astype(int)
    pdf.loc[[4, 9], "a"] = np.nan
    pdf.loc[[7, 9], "c"] = None
    df = spark.createDataFrame(pdf.astype({"a": object}).where(pdf.notna(), None), "id long, a double, b double, c string, d string, prediction int")
    explained = [0, 4, 7, 9, 50, 51, 299]
    keys = spark.createDataFrame([(i,) for i in explained], "id long")
    out = explain.local_rules(df, "id", keys, ["a", "b"], ["c", "d"])
    got = {r["id"]: (r["rule"], round(r["precision"], 9), round(r["coverage"], 9)) for r in out.collect()}
    assert got == _rules_by_hand(pdf, ["a", "b"], ["c", "d"], explained, 0.9, 3)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_binned_curve_is_near_the_exact_one(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 4000).astype(object), "x": rng.uniform(0, 100, 4000)})
    pdf["y"] = np.sin(pdf.x / 15) + rng.normal(0, 0.2, 4000)
    df = spark.createDataFrame(pdf)
    exact = smooth.kernel_curve(df, "x", "y", ["k"], points=30).toPandas().set_index(["k", "grid_index"])["curve"]
    for bins in (50, 400):
        got = smooth.kernel_curve(df, "x", "y", ["k"], points=30, bins=bins).toPandas().set_index(["k", "grid_index"])["curve"]
        h = 100 / 8
        bound = (100 / bins / h) ** 2 / 8
        # the kernel errs by the bound; numerator and denominator each by that share of the mass under it
        assert np.abs(got - exact).max() < 2 * bound * np.abs(pdf.y).max() * (100 / (h * np.sqrt(2 * np.pi))) + 1e-6
    band = smooth.kernel_curve_band(df, "x", "y", ["k"], replicates=100, points=10, bins=60).toPandas()
    assert ((band.lower <= band.curve + 0.01) & (band.curve - 0.01 <= band.upper)).all()
    assert 0.005 < (band.upper - band.lower).mean() < 0.1


def test_values_on_the_bin_grid_change_nothing(spark):
    pdf = pd.DataFrame({"k": ["a"] * 55, "x": list(range(11)) * 5, "y": np.arange(55) % 7})
    df = spark.createDataFrame(pdf)
    one, two = (smooth.kernel_curve(df, "x", "y", ["k"], points=9, bins=b).orderBy("grid_index").toPandas()["curve"] for b in (None, 10))
    assert np.allclose(one, two, atol=1e-6)


@pytest.mark.parametrize("held", [1, 2000])
def test_forward_selection_equals_least_squares(spark, held):
    rng = np.random.default_rng(8)
    rows = []
    for g in ("p", "q", None):
        for _ in range(60):
            u, v, w = rng.uniform(0.5, 3, 3)
            rows.append((g, float(u), float(v), float(w), float(2 * u * u - np.log(v) + (0.5 if g == "p" else -0.7) * w + rng.normal(0, 0.01))))
    df = spark.createDataFrame(rows, "g string, u double, v double, w double, y double").repartition(5)
    grams = equations.gram_table(df, ["g"], ["u", "v", "w"], "y", held=held)
    fits = equations.fit_forward(grams, terms=3).collect()
    assert len(fits) == 9
    forms = {f.name: f for f in equations.FORMS}
    fn = {"x": lambda x: x, "square": lambda x: x * x, "log": np.log, "inv": lambda x: 1 / x, "cube": lambda x: x ** 3, "quart": lambda x: x ** 4,
          "sqrt": np.sqrt, "exp": np.exp, "abs": np.abs, "sin": np.sin, "cos": np.cos, "tan": np.tan, "tanh": np.tanh, "cos2": lambda x: np.cos(x) ** 2}
    for r in fits:
        part = pd.DataFrame([x[1:] for x in rows if x[0] == r["g"]], columns=["u", "v", "w", "y"])
        A = np.column_stack([*[fn[f](part[x]) for x, f in zip(r["predictors"], r["forms"])], np.ones(len(part))])
        c, *_ = np.linalg.lstsq(A, part.y, rcond=None)
        assert np.allclose([*r["coefficients"], r["b"]], c, rtol=1e-6, atol=1e-7)
        assert abs(r["loss"] - ((part.y - A @ c) ** 2).mean()) < 1e-9
        assert r["complexity"] == sum(forms[f].complexity for f in r["forms"]) + 3 * len(c) - 2
        if r["step"] == 3:
            assert r["loss"] < 0.01 * part.y.var() and r["equation"].count("*") == 3


def test_sums_give_the_single_fits_too(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i % 3), float(x), float(abs(x) + e)) for i, (x, e) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    order = ["g", "predictor", "form", "variant"]
    a = equations.fit_equations(df, ["g"], "x", "y").orderBy(*order).toPandas()
    b = equations.fits_from_grams(equations.gram_table(df, ["g"], "x", "y")).orderBy(*order).toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, rtol=1e-6)


def test_cut_points_of_strings_do_not_depend_on_the_partitions(spark):
    df = spark.range(20_000).select(F.concat(F.lit("same-prefix-"), F.sha1(F.col("id").cast("string"))).alias("s"))
    cuts = [ranks._cut_points(d, "s", 16, uniform=False) for d in (df, df.repartition(3), df.repartition(31))]
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) == 15
    sizes = ranks._with_bucket(df, "s", cuts[0]).groupBy("__b").count().toPandas()["count"]
    assert sizes.max() < 1.3 * 20_000 / 16


def test_counterfactuals_of_any_size_equal_enumeration(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 6)), float(rng.integers(0, 6)), str(rng.choice(["u", "v"])), str(rng.choice(["p", "q", "r"]))) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, d string")
    values = {"a": ["0.0", "3.0", "5.0"], "b": ["1.0", "4.0"], "c": ["u", "v"], "d": ["p", "q", "r"]}
    cand = spark.createDataFrame([(f, v) for f, vs in values.items() for v in vs], "feature string, value string")

    def hit(a, b, c, d):
        return a + b >= 9 and c == "v" and d == "r"

    scorer = lambda x: x.withColumn("prediction", ((F.col("a") + F.col("b") >= 9) & (F.col("c") == "v") & (F.col("d") == "r")).cast("int"))
    out = explain.counterfactuals(scorer, df, "id", ["a", "b", "c", "d"], cand, lambda p: p == 1, n_rows=12, per_row=2, scales={"a": 2.0, "b": 2.0})
    got = {}
    for r in out.collect():
        got.setdefault((r["sample_id"], r["cf_id"]), {})[r["feature"]] = r["counterfactual"]
    sizes = set()
    for i, *row in rows:
        best = []
        for k in range(1, 5):
            for fs in itertools.combinations("abcd", k):
                for vs in itertools.product(*[values[f] for f in fs]):
                    new = dict(zip("abcd", row)) | {f: float(v) if f in "ab" else v for f, v in zip(fs, vs)}
                    if hit(**new):
                        dist = sum(abs(new[f] - row["ab".index(f)]) / 2 for f in "ab") + sum(new[f] != row["abcd".index(f)] for f in "cd")
                        best.append((k, dist, dict(zip(fs, vs))))
        best.sort(key=lambda x: x[:2])
        mine = [got[i, n] for n in (1, 2) if (i, n) in got]
        assert len(mine) == min(2, len(best))
        cost = {tuple(sorted(c.items())): (k, d) for k, d, c in best}
        assert [cost[tuple(sorted(m.items()))] for m in mine] == [b[:2] for b in best[:2]]
        sizes |= {len(m) for m in mine}
    assert max(sizes) >= 3
