"""Random-intercept model from sufficient statistics vs dense GLS in numpy."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelkit.operators import mixed


def _dense_loglik(y, X, groups, lam, s2):
    ll = 0.0
    for g in np.unique(groups):
        m = groups == g
        n = m.sum()
        V = s2 * (np.eye(n) + lam * np.ones((n, n)))
        r = y[m] - X[m] @ _dense_loglik.beta
        sign, ld = np.linalg.slogdet(V)
        ll += -0.5 * (n * math.log(2 * math.pi) + ld + r @ np.linalg.solve(V, r))
    return ll


def _data(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        u = rng.normal(0, 0.8)
        n = int(rng.integers(3, 12))
        cell = ["a", "b"][g % 2]
        for _ in range(n):
            x = rng.normal()
            rows.append((f"g{g}", cell, x, 1.0 + 0.5 * x + (0.3 if cell == "b" else 0.0) + u + rng.normal(0, 0.5)))
    return pd.DataFrame(rows, columns=["grp", "cell", "x", "y"])


def test_matches_dense_gls(spark):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    d = mixed.treatment_design(numeric=["x"], factors={"cell": ["a", "b"]})
    fit = mixed.fit(df, "y", d, "grp")
    X = np.column_stack([np.ones(len(pdf)), (pdf.cell == "b").astype(float), pdf.x])
    y = pdf.y.to_numpy()
    groups = pdf.grp.to_numpy()
    lam = fit.sigma2_u / fit.sigma2_e
    # GLS at the fitted lambda reproduces beta
    Vinv_blocks = []
    A = np.zeros((3, 3))
    b = np.zeros(3)
    for g in np.unique(groups):
        m = groups == g
        n = m.sum()
        Vi = np.linalg.inv(np.eye(n) + lam * np.ones((n, n)))
        A += X[m].T @ Vi @ X[m]
        b += X[m].T @ Vi @ y[m]
        Vinv_blocks.append(Vi)
    beta = np.linalg.solve(A, b)
    assert np.allclose(beta, fit.beta, atol=1e-8)
    _dense_loglik.beta = beta
    ll = _dense_loglik(y, X, groups, lam, fit.sigma2_e)
    assert abs(ll - fit.loglik) < 1e-6
    # it is a maximum along lambda
    for f in (0.8, 1.25):
        st = mixed.group_stats(df, "y", d, "grp")
        assert mixed._profile(st, lam * f, False)[0] <= fit.loglik + 1e-9


def test_lambda_zero_is_ols(spark):
    pdf = _data(2)
    pdf["grp"] = [f"r{i}" for i in range(len(pdf))]  # singleton groups: no group variance identifiable
    df = spark.createDataFrame(pdf)
    d = mixed.treatment_design(numeric=["x"])
    st = mixed.group_stats(df, "y", d, "grp")
    ll, beta, s2, _ = mixed._profile(st, 0.0, False)
    X = np.column_stack([np.ones(len(pdf)), pdf.x])
    ols = np.linalg.lstsq(X, pdf.y.to_numpy(), rcond=None)[0]
    assert np.allclose(beta, ols)


def test_aic_bic_golden(spark):
    """Published comparison rows: AIC/BIC follow from logL with k = p + 2, N = 2656."""
    f = mixed.MixedFit(["Intercept"], np.zeros(1), np.eye(1), 1.0, 1.0, -2390.0628, 2656, 134, False)
    t = mixed.compare(spark, {"M0": f}).first()
    assert round(t["AIC"], 4) == 4786.1256 or round(t["AIC"], 3) == 4786.126
    assert abs(t["BIC"] - 4803.779) < 1e-3
    f1 = mixed.MixedFit(["b"] * 6, np.zeros(6), np.eye(6), 1.0, 1.0, -2356.5209, 2656, 134, False)
    f2 = mixed.MixedFit(["b"] * 10, np.zeros(10), np.eye(10), 1.0, 1.0, -2349.2249, 2656, 134, False)
    rows = mixed.compare(spark, {"M1": f1, "M2": f2}).collect()
    assert abs(rows[0]["AIC"] - 4729.0418) < 1e-3
    assert abs(rows[1]["AIC"] - 4722.4498) < 1e-3
    assert abs(rows[1]["LR_vs_prev"] - 14.592) < 1e-3
    assert rows[1]["d_df"] == 4
    assert round(rows[1]["p_LR"], 4) == 0.0056


def test_icc_golden(spark):
    f = mixed.MixedFit(["Intercept"], np.zeros(1), np.eye(1), 0.2921, 0.6587, 0.0, 10, 2, False)
    assert round(mixed.icc(spark, f).first()["ICC"], 4) == 0.6928


def test_marginal_grid_shape(spark):
    pdf = _data(3)
    df = spark.createDataFrame(pdf)
    d = mixed.treatment_design(numeric=["x"], factors={"cell": ["a", "b"]})
    fit = mixed.fit(df, "y", d, "grp")
    g = mixed.marginal_grid(df, fit, d, "x", ["cell"], points=10, interval=True)
    assert g.count() == 20
    row = g.where(F.col("cell") == "a").orderBy("x").first()
    assert row["lower"] < row["prediction"] < row["upper"]
