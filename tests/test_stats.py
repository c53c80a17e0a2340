"""Splits, Holm, metrics and ART invariants."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelkit.operators import metrics, nonparam, ranks, split

from core_cases import SF_MID


def test_group_split_disjoint(spark):
    from panelkit.sources import fixtures as fx

    r = split.group_split(fx.ratings(spark, SF_MID), "participant")
    both = r.groupBy("participant").agg(F.count_distinct("split").alias("k")).where("k > 1").count()
    assert both == 0
    n_test = r.where("split = 'test'").select("participant").distinct().count()
    n_all = r.select("participant").distinct().count()
    assert n_test == int(np.ceil(0.2 * n_all))


def test_exact_split_sizes(spark):
    df = spark.range(1003).withColumn("k", F.col("id").cast("string"))
    s = split.exact_split(df, "k").groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in s}
    assert got == {"train": 802, "valid": 100, "test": 101}


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p double")
    got = {r["id"]: r["p_holm"] for r in ranks.holm(df, "p").collect()}
    # R p.adjust(c(.01,.04,.03,.005), "holm") = 0.03 0.06 0.06 0.02
    assert np.allclose([got[i] for i in range(4)], [0.03, 0.06, 0.06, 0.02])


def test_calibration_fixture(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        y = int(rng.integers(0, 5))
        probs = [0.0] * 5
        if rng.random() < 0.7:
            probs[y] = 0.8
            probs[(y + 1) % 5] = 0.2
        else:
            probs = list(rng.dirichlet(np.ones(5)))
        rows.append((i, y, [float(x) for x in probs]))
    df = spark.createDataFrame(rows, "row_id long, y_true int, probs array<double>")
    e = metrics.ece(df, "y_true", "probs").first()["ece"]
    assert 0.0 <= e <= 1.0
    bins = metrics.calibration_bins(df, "y_true", "probs").toPandas()
    assert bins["count"].sum() == 200
    # numpy reference for ECE
    conf = np.array([max(r[2]) for r in rows])
    pred = np.array([int(np.argmax(r[2])) for r in rows])
    ok = (pred == np.array([r[1] for r in rows])).astype(float)
    b = np.minimum(9, np.floor(conf * 10)).astype(int)
    ece = sum((b == k).sum() / 200 * abs(ok[b == k].mean() - conf[b == k].mean()) for k in range(10) if (b == k).any())
    assert abs(ece - e) < 1e-12


def _art_numpy(pdf, y, a, b, c, s):
    """Independent ART: explicit alignment, scipy-free average ranks, and
    F from the split-plot sums of squares computed with pandas group means."""
    out = {}
    facs = [a, b, c]
    import itertools

    def m(df, cols, col):
        if not cols:
            return pd.Series(df[col].mean(), index=df.index)
        return df.groupby(cols)[col].transform("mean")

    effects = [e for k in (1, 2, 3) for e in itertools.combinations(facs, k)]
    for e in effects:
        full = m(pdf, facs, y)
        est = sum((-1) ** (len(e) - k) * m(pdf, list(t), y) for k in range(len(e) + 1)
                  for t in itertools.combinations(e, k))
        al = (pdf[y] - full + est).round(9)
        d = pdf.assign(r=al.rank(method="average"))
        eff = sum((-1) ** (len(e) - k) * m(d, list(t), "r") for k in range(len(e) + 1)
                  for t in itertools.combinations(e, k))
        ss_e = float((eff ** 2).sum())
        dfe = int(np.prod([d[f].nunique() - 1 for f in e]))
        ns, nb = d[s].nunique(), d[[a, b]].drop_duplicates().shape[0]
        if c in e:
            res = d["r"] - m(d, [s], "r") - m(d, [a, b, c], "r") + m(d, [a, b], "r")
            ss_err, dferr = float((res ** 2).sum()), (ns - nb) * (d[c].nunique() - 1)
        else:
            res = m(d, [s], "r") - m(d, [a, b], "r")
            ss_err, dferr = float((res ** 2).sum()), ns - nb
        out[":".join(e)] = (ss_e / dfe) / (ss_err / dferr)
    return out


def test_art_matches_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for sid in range(24):
        a, b = ["x", "y"][sid % 2], ["p", "q", "r"][sid % 3]
        u = rng.normal()
        for c in range(4):
            rows.append((f"s{sid}", a, b, c, float(np.round(2 * (u + 0.3 * c + (a == "y") + rng.normal()), 0) / 2)))
    pdf = pd.DataFrame(rows, columns=["s", "a", "b", "c", "y"])
    res = nonparam.art_anova(spark.createDataFrame(pdf), "y", ["a", "b"], ["c"], "s").toPandas()
    exp = _art_numpy(pdf, "y", "a", "b", "c", "s")
    for _, r in res.iterrows():
        assert abs(r["F"] - exp[r["effect"]]) < 1e-8 * max(1, abs(exp[r["effect"]])), (r["effect"], r["F"], exp)
    assert set(res["df_error"]) == {18, 54}


def test_poisson_quantiles_moments():
    from panelkit.functions.tails import poisson_quantile, poisson_quantiles

    rng = np.random.default_rng(0)
    for lam in (0.7, 12.0, 3000.0):
        u = rng.random(20000)
        x = poisson_quantiles(u, np.full(len(u), lam))
        assert abs(x.mean() - lam) < 5 * np.sqrt(lam / len(u)) + 1e-9
        assert abs(x.var() / lam - 1) < 0.05
        assert all(x[i] == poisson_quantile(u[i], lam) for i in range(50))


def test_sample_n_exact_under_skew(spark):
    from panelkit.functions.random import portable_uniform

    rows = [("hot", i) for i in range(3000)] + [("small", i) for i in range(7)] + [("mid", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = split.sample_n(df, 20, "k", by=["g"], seed=3).toPandas()
    ref = (df.withColumn("u", portable_uniform(F.lit(3), F.col("k"))).toPandas()
           .sort_values(["g", "u", "k"]).groupby("g").head(20))
    assert sorted(zip(got.g, got.k)) == sorted(zip(ref.g, ref.k))


def test_eta2_ci():
    from panelkit.functions.tails import eta2_partial_ci, f_upper, ncf_cdf

    assert abs((1 - ncf_cdf(3.0, 2, 10, 0.0)) - f_upper(3.0, 2, 10)) < 1e-12
    # noncentral CDF decreases in the noncentrality
    assert ncf_cdf(3.0, 2, 10, 5.0) < ncf_cdf(3.0, 2, 10, 1.0)
    f, d1, d2 = 6.86, 19, 2147
    lo, hi = eta2_partial_ci(f, d1, d2)
    point = f * d1 / (f * d1 + d2)
    assert 0 < lo < point < hi < 1
    lo0, _ = eta2_partial_ci(0.5, 2, 50)
    assert lo0 == 0.0
