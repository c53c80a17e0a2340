"""Random-slope model: collapsed likelihood equals the dense one."""

import math

import numpy as np
import pandas as pd

from panelkit.operators import mixed, mixed_slope


def _data(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        u0, u1 = rng.normal(0, 0.7), rng.normal(0, 0.3)
        cell = ["a", "b"][g % 2]
        for z in range(5):
            y = 1 + 0.4 * z + (0.5 if cell == "b" else 0) + u0 + u1 * z + rng.normal(0, 0.4)
            rows.append((f"g{g}", cell, float(z), y))
    return pd.DataFrame(rows, columns=["grp", "cell", "z", "y"])


def _dense_dev(pdf, X, theta, reml):
    L = np.array([[theta[0], 0], [theta[1], theta[2]]])
    y = pdf.y.to_numpy()
    Vs, idx = [], []
    for g in pdf.grp.unique():
        m = (pdf.grp == g).to_numpy()
        Z = np.column_stack([np.ones(m.sum()), pdf.z[m]])
        Vs.append(np.eye(m.sum()) + Z @ L @ L.T @ Z.T)
        idx.append(m)
    XtX = sum(X[m].T @ np.linalg.solve(V, X[m]) for V, m in zip(Vs, idx))
    Xty = sum(X[m].T @ np.linalg.solve(V, y[m]) for V, m in zip(Vs, idx))
    beta = np.linalg.solve(XtX, Xty)
    rss = sum((y[m] - X[m] @ beta) @ np.linalg.solve(V, y[m] - X[m] @ beta) for V, m in zip(Vs, idx))
    N, p = len(y), X.shape[1]
    dof = N - p if reml else N
    s2 = rss / dof
    logdet = sum(np.linalg.slogdet(V)[1] for V in Vs)
    dev = dof * math.log(2 * math.pi * s2) + logdet + rss / s2
    if reml:
        dev += np.linalg.slogdet(XtX)[1]
    return dev, beta


def _dense_design(pdf):
    return np.column_stack([np.ones(len(pdf)), (pdf.cell == "b").astype(float), pdf.z])


def _design():
    return mixed.treatment_design(numeric=["z"], factors={"cell": ["a", "b"]})


def _check_dense(st, pdf):
    X = _dense_design(pdf)
    for theta in ([1.0, 0.2, 0.4], [0.5, -0.1, 0.0]):
        own = (theta[0], theta[1] * st.scale, theta[2] * st.scale)  # L is relative to z / scale
        for reml in (True, False):
            got = mixed_slope.evaluate(st, {0: own}, reml)[0]
            exp, beta_e = _dense_dev(pdf, X, theta, reml)
            assert abs(got.dev - exp) < 1e-8 and np.allclose(got.beta, beta_e)


def test_collapsed_equals_dense(spark):
    pdf = _data()
    st = mixed_slope.slope_stats(spark.createDataFrame(pdf), "y", _design(), "grp", "z")
    assert (st.N, st.G) == (150, 30)
    # one pattern for all groups: at most as many rows as W has entries
    assert st.rows.count() == 2 * (3 + 1) and st.rows.select("k0", "k1", "k2").distinct().count() == 1
    _check_dense(st, pdf)


def test_patterns_of_one_group_each_equal_dense(spark):
    pdf = _data()
    pdf["z"] = pdf.z + pdf.grp.str[1:].astype(int) * 0.137
    pdf = pdf.drop(pdf.index[[3, 17, 18, 60]])
    st = mixed_slope.slope_stats(spark.createDataFrame(pdf).repartition(7), "y", _design(), "grp", "z", held=5)
    assert st.rows.count() == 30
    _check_dense(st, pdf)


def test_derivatives_equal_differences(spark):
    st = mixed_slope.slope_stats(spark.createDataFrame(_data()), "y", _design(), "grp", "z")
    th, h = np.array([0.9, 0.15, 0.5]), 1e-5
    for reml in (True, False):
        at = mixed_slope.evaluate(st, {0: th}, reml)[0]
        for a in range(3):
            e = np.eye(3)[a] * h
            up, down = (mixed_slope.evaluate(st, {0: th + s * e}, reml)[0] for s in (1, -1))
            assert abs((up.dev - down.dev) / (2 * h) - at.grad[a]) < 1e-5
            assert np.allclose((up.grad - down.grad) / (2 * h), at.hess[a], atol=1e-5, rtol=1e-6)


def test_fit_is_a_minimum_of_the_dense_deviance(spark):
    pdf = _data(9)
    st = mixed_slope.slope_stats(spark.createDataFrame(pdf), "y", _design(), "grp", "z")
    fit = mixed_slope.fit_random_slope(st)["y"]
    assert fit.random_structure == "intercept+slope" and fit.converged and fit.evaluations < 30
    X = _dense_design(pdf)
    own = fit.point.theta * [1, 1 / st.scale, 1 / st.scale]
    least = _dense_dev(pdf, X, own, True)[0]
    assert abs(least - fit.deviance) < 1e-8
    rng = np.random.default_rng(0)
    for size in (0.3, 0.03, 0.003):
        for _ in range(20):
            assert _dense_dev(pdf, X, own + rng.normal(0, size, 3), True)[0] > least - 1e-9
    t = mixed_slope.type3_tests(spark, {"y": fit}, {"z": ["z"], "cell": ["C(cell)[T.b]"]}).toPandas().set_index("term")
    # slope df: about groups - 1; between-group factor: about groups - 2
    assert 15 < t.loc["z", "DenDF"] < 60
    assert 15 < t.loc["cell", "DenDF"] < 60
    assert t.loc["z", "p"] < 1e-3 and t.loc["z", "converged"]


def test_balanced_data_have_the_degrees_of_freedom_of_the_analysis_of_variance(spark):
    """Balanced random slopes: the slope is tested on groups - 1 degrees."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        u0, u1 = rng.normal(0, 1), rng.normal(0, 1)
        rows += [(f"g{g}", float(z), 2 + z + u0 + u1 * z + rng.normal(0, 0.5)) for z in (-2, -1, 0, 1, 2)]
    df = spark.createDataFrame(rows, "grp string, z double, y double")
    st = mixed_slope.slope_stats(df, "y", mixed.treatment_design(numeric=["z"]), "grp", "z")
    t = mixed_slope.type3_tests(spark, mixed_slope.fit_random_slope(st), {"z": ["z"]}).first()
    assert abs(t["DenDF"] - 24) < 1e-4
    slopes = [np.polyfit([r[1] for r in rows[i:i + 5]], [r[2] for r in rows[i:i + 5]], 1)[0] for i in range(0, 125, 5)]
    assert abs(t["F"] - 25 * np.mean(slopes) ** 2 / np.var(slopes, ddof=1)) < 1e-5 * t["F"]


def test_many_responses_equal_one_by_one(spark):
    pdf = _data(9)
    rng = np.random.default_rng(1)
    pdf["flat"] = rng.normal(0, 1, len(pdf))  # no random effects at all
    pdf["neg"] = 3 - 2 * pdf.y
    pdf["shift"] = pdf.y + pdf.grp.str[1:].astype(int) % 3
    df = spark.createDataFrame(pdf)
    ys = ["y", "flat", "neg", "shift"]
    together = mixed_slope.fit_random_slope(mixed_slope.slope_stats(df, ys, _design(), "grp", "z"))
    assert list(together) == ys and all(f.converged for f in together.values())
    assert together["flat"].random_structure == "intercept"
    assert abs(together["neg"].s2 - 4 * together["y"].s2) < 1e-6
    for y in ys:
        alone = mixed_slope.fit_random_slope(mixed_slope.slope_stats(df, y, _design(), "grp", "z"))[y]
        assert abs(alone.deviance - together[y].deviance) < 1e-7 and np.allclose(alone.beta, together[y].beta, atol=1e-6)


def test_missing_classes(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, 3.0, 4.0)], "a double, b double, c double")
    assert mixed_slope.missing_classes(df, ["a", "b", "c"]) == [["a", "c"], ["b"]]


def test_unit_of_the_slope_column_does_not_matter(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(30):
        b0, b1 = rng.normal(0, 1), rng.normal(0, 0.5)
        for _ in range(8):
            z = float(rng.normal())
            rows.append((f"g{g}", z, float(1 + b0 + (0.7 + b1) * z + rng.normal(0, 0.3))))
    d = mixed.treatment_design(numeric=["z"])
    fits = []
    for unit in (1.0, 1e-3, 1e4):
        df = spark.createDataFrame([(g, z * unit, y) for g, z, y in rows], "g string, z double, y double")
        fits.append(mixed_slope.fit_random_slope(mixed_slope.slope_stats(df, "y", d, "g", "z"))["y"])
    for f, unit in zip(fits, (1.0, 1e-3, 1e4)):
        assert f.converged and np.allclose(f.D * [[1, unit], [unit, unit ** 2]], fits[0].D, rtol=1e-4)
        assert abs(f.s2 - fits[0].s2) < 1e-8


def test_three_way_terms(spark):
    from pyspark.sql import functions as F

    d, groups = mixed.sum_design(["z"], {"a": ["u", "v"], "b": ["p", "q", "r"]}, mixed.full_crossing(["a", "b", "z"]))
    assert groups["a:b:z"] == ["C(a, Sum)[S.u]:C(b, Sum)[S.p]:z", "C(a, Sum)[S.u]:C(b, Sum)[S.q]:z"]
    df = spark.createDataFrame([("v", "r", 3.0), ("u", "q", 2.0)], "a string, b string, z double")
    got = df.select(*[c.alias(n) for n, c in d.terms]).collect()
    assert got[0]["C(a, Sum)[S.u]:C(b, Sum)[S.p]:z"] == (-1) * (-1) * 3 and got[1]["C(a, Sum)[S.u]:C(b, Sum)[S.q]:z"] == 2
