"""Metrics and equation fits vs independent numpy computations."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelkit.operators import equations, metrics


def _pairs(seed=0, n=500, k=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    p = np.where(rng.random(n) < 0.6, y, rng.integers(0, k, n))
    return y, p


def test_kappa_and_macro_vs_numpy(spark):
    y, p = _pairs()
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(int), "p": p.astype(int)}))
    k = 5
    O = np.zeros((k, k))
    for a, b in zip(y, p):
        O[a, b] += 1
    E = np.outer(O.sum(1), O.sum(0)) / O.sum()
    W = np.subtract.outer(np.arange(k), np.arange(k)) ** 2
    qwk = 1 - (W * O).sum() / (W * E).sum()
    assert abs(metrics.quadratic_kappa(df, "y", "p", k).first()["qwk"] - qwk) < 1e-12
    tp = np.diag(O)
    fp, fn = O.sum(0) - tp, O.sum(1) - tp
    f1 = 2 * tp / (2 * tp + fp + fn)
    r = metrics.macro_scores(df, "y", "p", k).first()
    assert abs(r["macro_f1"] - f1.mean()) < 1e-12
    assert abs(r["macro_accuracy"] - (tp / (tp + fn)).mean()) < 1e-12
    assert abs(r["accuracy"] - tp.sum() / O.sum()) < 1e-12
    conf = metrics.confusion(df, "y", "p", k).toPandas()
    assert conf["count"].sum() == len(y) and len(conf) == k * k


def test_regression_metrics_vs_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=300)
    f = y + rng.normal(scale=0.3, size=300)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "f": f}))
    r = metrics.regression_metrics(df, "y", "f").first()
    assert abs(r["mae"] - np.abs(y - f).mean()) < 1e-12
    assert abs(r["r2"] - (1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-10


def test_equation_fits_vs_lstsq(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b"):
        x = rng.uniform(60, 90, 200)
        y = (2.0 + 0.05 * x if g == "a" else 1.0 + 30 / x) + rng.normal(scale=0.2, size=200)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    fits = equations.fit_equations(spark.createDataFrame(pdf), ["g"], "x", "y").toPandas()
    for g in ("a", "b"):
        sub = pdf[pdf.g == g]
        for form, fx in (("x", sub.x), ("inv", 1 / sub.x), ("log", np.log(sub.x)), ("sqrt", np.sqrt(sub.x))):
            A = np.column_stack([fx, np.ones(len(sub))])
            coef, *_ = np.linalg.lstsq(A, sub.y, rcond=None)
            mse = ((sub.y - A @ coef) ** 2).mean()
            row = fits[(fits.g == g) & (fits.form == form) & (fits.variant == "affine")].iloc[0]
            assert abs(row["a"] - coef[0]) < 1e-6 * max(1, abs(coef[0]))
            assert abs(row["loss"] - mse) < 1e-9
        c = fits[(fits.g == g) & (fits.form == "const")].iloc[0]
        assert abs(c["loss"] - sub.y.var(ddof=0)) < 1e-9
    hof = equations.hall_of_fame(spark.createDataFrame(fits), ["g"]).toPandas()
    for g in ("a", "b"):
        h = hof[hof.g == g].sort_values("complexity")
        assert (np.diff(h["loss"].to_numpy()) < 0).all()  # Pareto losses strictly fall
        assert h["chosen"].sum() == 1 and h["score"].iloc[0] == 0.0
    best_b = hof[(hof.g == "b") & hof.chosen].iloc[0]
    assert best_b["form"] in ("inv", "log", "sqrt", "x")


def test_two_term_fits_vs_lstsq(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b", None):
        u = rng.uniform(1, 5, 300)
        v = rng.uniform(0.5, 3, 300)
        y = 1.0 + 0.8 * u + 2.0 * np.log(v) + rng.normal(scale=0.1, size=300)
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(u, v, y)]
    pdf = pd.DataFrame(rows, columns=["g", "u", "v", "y"])
    sdf = spark.createDataFrame(pdf, "g string, u double, v double, y double")
    fits = equations.fit_equations(sdf, ["g"], ["u", "v"], "y")
    two = equations.fit_two_term(sdf, ["g"], ["u", "v"], "y", fits=fits).toPandas()
    one = fits.toPandas()
    fx = {"x": lambda s: s, "log": np.log, "sqrt": np.sqrt, "inv": lambda s: 1 / s, "square": lambda s: s * s}
    for g in ("a", "b", None):
        sub = pdf[pdf.g == g] if g is not None else pdf[pdf.g.isna()]
        t = two[two.g == g] if g is not None else two[two.g.isna()]
        o = one[((one.g == g) if g is not None else one.g.isna()) & (one.variant == "affine")]
        first = o.sort_values(["loss", "predictor", "form"]).iloc[0]
        assert (t.predictor == first.predictor).all() and (t.form == first.form).all()
        assert not ((t.predictor2 == first.predictor) & (t.form2 == first.form)).any()
        g1 = fx[first.form](sub[first.predictor]) if first.form in fx else None
        assert g1 is not None
        for p2 in ("u", "v"):
            for f2, fn in fx.items():
                if (p2, f2) == (first.predictor, first.form):
                    continue
                A = np.column_stack([g1, fn(sub[p2]), np.ones(len(sub))])
                coef, *_ = np.linalg.lstsq(A, sub.y, rcond=None)
                mse = ((sub.y - A @ coef) ** 2).mean()
                r = t[(t.predictor2 == p2) & (t.form2 == f2)].iloc[0]
                assert abs(r["a"] - coef[0]) < 1e-6 * max(1, abs(coef[0])), (g, first.predictor, first.form, p2, f2)
                assert abs(r["a2"] - coef[1]) < 1e-6 * max(1, abs(coef[1]))
                assert abs(r["b"] - coef[2]) < 1e-6 * max(1, abs(coef[2]))
                assert abs(r["loss"] - mse) < 1e-9
        best = t.sort_values("loss").iloc[0]
        assert {best.predictor, best.predictor2} == {"u", "v"}
    hof = equations.hall_of_fame(equations.with_two_term(fits, equations.fit_two_term(sdf, ["g"], ["u", "v"], "y")),
                                 ["g"]).toPandas()
    assert (hof.variant == "two_term").any()
    assert hof.groupby(hof.g.fillna("~"))["chosen"].sum().eq(1).all()
