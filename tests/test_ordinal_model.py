"""Ordinal mixed models: likelihood against dense integration, derivatives,
recovery of simulated effects."""

import math

import numpy as np
import pandas as pd
import pytest

from panelkit.operators import mixed, ordinal


def _sim(seed=0, groups=60, per=12, sigma=0.8, beta=1.2):
    rng = np.random.default_rng(seed)
    th = np.array([-1.0, 0.0, 1.0])
    rows = []
    for g in range(groups):
        u = rng.normal(0, sigma)
        for _ in range(per):
            x = rng.normal()
            lat = beta * x + u + rng.logistic()
            rows.append((f"g{g}", x, int(np.searchsorted(th, lat))))
    return pd.DataFrame(rows, columns=["grp", "x", "y"])


def _design():
    return mixed.treatment_design(numeric=["x"], intercept=False)


def _dense(pdf, psi, m):
    """Log-likelihood by a fine sum over v."""
    v = np.linspace(-9, 9, 20_001)
    ends = np.concatenate([[-np.inf], psi[:m], [np.inf]])
    total = 0.0
    for _, g in pdf.groupby("grp"):
        at = psi[m] * g.x.to_numpy()[:, None] + psi[-1] * v
        y = g.y.to_numpy()
        cdf = lambda t: 1 / (1 + np.exp(-t))
        lp = np.log(cdf(ends[y + 1][:, None] - at) - cdf(ends[y][:, None] - at)).sum(axis=0) - v * v / 2
        total += lp.max() + math.log(np.exp(lp - lp.max()).sum() * (v[1] - v[0]) / math.sqrt(2 * math.pi))
    return total


PSI = np.array([-0.8, 0.1, 1.1, 0.7, 0.6])


def test_derivatives_match_differences(spark):
    st = ordinal.ordinal_stats(spark.createDataFrame(_sim(1, groups=10, per=6)), "y", _design(), "grp", 4, nodes=25)
    at = ordinal.evaluate(st, {0: PSI})[0]
    for i in range(len(PSI)):
        e = np.eye(len(PSI))[i] * 1e-4
        up, down = (ordinal.evaluate(st, {0: PSI + s * e})[0] for s in (1, -1))
        assert abs((up.loglik - down.loglik) / 2e-4 - at.grad[i]) < 1e-4 * max(1, abs(at.grad[i]))
        assert np.allclose((up.grad - down.grad) / 2e-4, at.hess[i], rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("groups, per", [(10, 6), (4, 200)])
def test_likelihood_equals_dense_integration(spark, groups, per):
    pdf = _sim(3, groups=groups, per=per, sigma=2.5)
    st = ordinal.ordinal_stats(spark.createDataFrame(pdf).repartition(5), "y", _design(), "grp", 4)
    for psi in (PSI, np.array([-1.0, 0.0, 1.0, 1.2, 2.5])):
        want = _dense(pdf, psi, 3)
        assert abs(ordinal.evaluate(st, {0: psi})[0].loglik - want) < 1e-6 * abs(want)


def test_many_responses_and_gaps_equal_one_by_one(spark):
    pdf = _sim(5, groups=30, per=8)
    pdf["two"] = (pdf.y >= 2).astype(int)
    pdf["gaps"] = pdf.y.where(np.arange(len(pdf)) % 7 > 0)
    pdf = pd.concat([pdf, pdf.iloc[:40]], ignore_index=True)  # repeated rows count twice
    df = spark.createDataFrame(pdf.astype({"gaps": object}).where(pdf.notna(), None), "grp string, x double, y int, two int, gaps double")
    st = ordinal.ordinal_stats(df, ["y", "two", "gaps"], _design(), "grp", [4, 2, 4])
    fits = ordinal.fit_all(st)
    assert all(f.converged and f.evaluations < 30 for f in fits.values())
    for y, k in (("two", 2), ("gaps", 4)):
        alone = ordinal.fit_ordinal_mixed(df.where(f"{y} IS NOT NULL"), y, _design(), "grp", k)
        assert abs(alone.loglik - fits[y].loglik) < 1e-6 and np.allclose(alone.beta, fits[y].beta, atol=1e-5)
    t = ordinal.ordinal_table(spark, fits).toPandas()
    assert set(t.dv) == {"y", "two", "gaps"} and t.converged.all()


def test_recovers_effects(spark):
    df = spark.createDataFrame(_sim(2))
    d = mixed.treatment_design(numeric=["x"], intercept=False)
    fit = ordinal.fit_ordinal_mixed(df, "y", d, "grp", 4)
    assert abs(fit.beta[0] - 1.2) < 0.35
    assert 0.3 < fit.sigma < 1.5
    assert np.all(np.diff(fit.thresholds) > 0)
    assert fit.converged and fit.evaluations < 30
