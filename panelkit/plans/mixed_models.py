"""Mixed-model queries (survey J1-J5, J13)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelkit.operators import clean, mixed
from panelkit.plans.registry import register
from panelkit.plans.screening import CLEAN_SQL, clean_ratings
from panelkit.sources import fixtures as fx

INTRO_LEVELS = ["ambiguous", "boasting"]
SCENARIO_LEVELS = ["3Spurig", "NeueMitte", "Spielstrasse", "Ueberland"]


def _prepared(spark, sf_dir):
    r = clean_ratings(spark, sf_dir).withColumn(
        "rating_signal", F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("rating") + (F.col("quality") - 76.5) / 10)))
    return clean.center(r, "quality", "quality_c")


def designs():
    fac = {"introduction": INTRO_LEVELS, "scenario": SCENARIO_LEVELS}
    return {
        "M0": mixed.treatment_design(),
        "M1": mixed.treatment_design(numeric=["quality_c"], factors=fac),
        "M2": mixed.treatment_design(numeric=["quality_c"], factors=fac,
                                     interactions=[("quality_c", "introduction"), ("quality_c", "scenario")]),
    }


def _fits(spark, sf_dir, y="rating_signal"):
    df = _prepared(spark, sf_dir).cache()
    fits = {name: mixed.fit(df, y, d, "participant", reml=False) for name, d in designs().items()}
    return df, fits


# ------------------------------------------------------------------ J1 statistics (exact, SQL)
def mixed_group_stats(spark, sf_dir):
    """The per-size sums that the random-intercept fit itself uses."""
    st = mixed.group_stats(fx.ratings(spark, sf_dir), "rating", mixed.treatment_design(numeric=["quality"]), "participant")
    rows = [(int(n), int(g), float(u), float(t[1]), float(S[1, 1]))
            for n, g, u, t, S in zip(st.sizes, st.counts, st.u, st.t, st.S)]
    return spark.createDataFrame(rows, "n long, groups long, u double, t1 double, s11 double")


register("mixed_group_stats", "J1 F4", fx.with_views("""
, g AS (SELECT participant, count(*) AS n, sum(rating) AS sy, sum(quality) AS sx1 FROM ratings GROUP BY 1)
SELECT n, count(*) AS groups, CAST(sum(sy * sy) AS DOUBLE) AS u, CAST(sum(sx1 * sy) AS DOUBLE) AS t1,
       CAST(sum(sx1 * sx1) AS DOUBLE) AS s11 FROM g GROUP BY n""",
                                                     "ratings").replace("\n, g AS", ",\ng AS"))(mixed_group_stats)


# ------------------------------------------------------------------ J1, J2, E7
def mixed_comparison(spark, sf_dir):
    _, fits = _fits(spark, sf_dir)
    return mixed.compare(spark, fits)


register("mixed_comparison", "J1 J2 E7")(mixed_comparison)


def mixed_fixed_effects(spark, sf_dir):
    _, fits = _fits(spark, sf_dir)
    return mixed.fixed_effects(spark, fits["M2"]).withColumn(
        "significant", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


register("mixed_fixed_effects", "J3 B30 B31 B33")(mixed_fixed_effects)


def mixed_icc(spark, sf_dir):
    df = _prepared(spark, sf_dir)
    f0 = mixed.fit(df, "rating_signal", designs()["M0"], "participant")
    return mixed.icc(spark, f0)


register("mixed_icc", "J4 F7")(mixed_icc)


def mixed_marginal_grid(spark, sf_dir):
    df, fits = _fits(spark, sf_dir)
    return mixed.marginal_grid(df, fits["M2"], designs()["M2"], "quality_c", ["introduction", "scenario"], 60)


register("mixed_marginal_grid", "J5 C6")(mixed_marginal_grid)


def mixed_prediction_interval(spark, sf_dir):
    df, fits = _fits(spark, sf_dir)
    return mixed.marginal_grid(df, fits["M1"], designs()["M1"], "quality_c", ["introduction", "scenario"], 100,
                               interval=True)


register("mixed_prediction_interval", "J13")(mixed_prediction_interval)


# ------------------------------------------------------------------ J5, E7 from given coefficients
def _given_fit(names, loglik=0.0, n=1):
    """A fit with coefficients 1, -1/2, 1/3, ... and no variances."""
    beta = np.array([(-1) ** j / (j + 1) for j in range(len(names))])
    return mixed.MixedFit(list(names), beta, np.zeros((len(beta), len(beta))), 0.0, 0.0, loglik, n, 1, False)


def marginal_grid_given(spark, sf_dir):
    """J5 with given coefficients: predictions on 30 points for every cell."""
    r = clean_ratings(spark, sf_dir).where(F.col("introduction").isNotNull())
    d = mixed.treatment_design(numeric=["quality"], factors={"introduction": INTRO_LEVELS, "scenario": SCENARIO_LEVELS},
                               interactions=[("quality", "introduction")])
    out = mixed.marginal_grid(r, _given_fit(d.names()), d, "quality", ["introduction", "scenario"], 30)
    return out.select("introduction", "scenario", F.round("quality", 6).alias("quality"), F.round("prediction", 6).alias("prediction"))


def _marginal_sql() -> str:
    terms = ["1.0"] + [f"CAST({f} = '{x}' AS DOUBLE)" for f, levels in (("introduction", INTRO_LEVELS), ("scenario", SCENARIO_LEVELS)) for x in levels[1:]]
    terms += ["x", f"x * CAST(introduction = '{INTRO_LEVELS[1]}' AS DOUBLE)"]
    value = " + ".join(f"({(-1) ** j / (j + 1)!r}::DOUBLE * {t})" for j, t in enumerate(terms))
    base = fx.with_views("SELECT 1", "ratings")[: -len("\nSELECT 1")]
    return base + ",\n" + CLEAN_SQL.strip() + f""",
src AS (SELECT * FROM clean WHERE introduction IS NOT NULL),
lim AS (SELECT min(quality) AS lo, max(quality) AS hi FROM src),
g AS (SELECT introduction, scenario, lo + (hi - lo) * i / 29 AS x FROM (SELECT DISTINCT introduction, scenario FROM src), lim, range(30) t(i))
SELECT introduction, scenario, round(x, 6) AS quality, round({value}, 6) AS prediction FROM g"""


register("marginal_grid_given", "J5 C6", _marginal_sql())(marginal_grid_given)


def comparison_given(spark, sf_dir):
    """E7, J2 from given log-likelihoods (sums over the ratings): LR and
    degrees of freedom against the previous model, AIC and BIC."""
    s = fx.ratings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("r"), F.sum("quality").alias("q")).first()
    logl = {"M0": -s["q"], "M1": -s["q"] + s["r"], "M2": -s["q"] + s["r"] + 7.5}
    fits = {m: _given_fit(["b"] * p, float(logl[m]), int(s["n"])) for m, p in (("M0", 1), ("M1", 6), ("M2", 10))}
    out = mixed.compare(spark, fits)
    return out.select("model", "logL", "AIC", F.round("BIC", 4).alias("BIC"), "df_resid", "n_params", "LR_vs_prev", "d_df")


register("comparison_given", "J2 E7", fx.with_views("""
SELECT model, logL, -2 * logL + 2 * (p + 2) AS AIC, round(-2 * logL + (p + 2) * ln(n), 4) AS BIC, CAST(n - p AS INT) AS df_resid,
       CAST(p + 1 AS INT) AS n_params, 2 * (logL - lag(logL) OVER (ORDER BY model)) AS LR_vs_prev,
       CAST(p - lag(p) OVER (ORDER BY model) AS INT) AS d_df
FROM (SELECT m AS model, p, n, CAST(-q + a * r + b AS DOUBLE) AS logL
      FROM (SELECT count(*) AS n, sum(rating) AS r, sum(quality) AS q FROM ratings), (VALUES ('M0', 1, 0, 0.0), ('M1', 6, 1, 0.0), ('M2', 10, 1, 7.5)) v(m, p, a, b))""",
                                                   "ratings"))(comparison_given)


# ------------------------------------------------------------------ J6 random slope, type III
def _slope_design():
    """Full crossing of both factors with quality, sum-coded."""
    return mixed.sum_design(numeric=["quality_c"], factors={"introduction": INTRO_LEVELS, "scenario": SCENARIO_LEVELS},
                            interactions=mixed.full_crossing(["introduction", "scenario", "quality_c"]))


def random_slope_anova(spark, sf_dir):
    """Type III tables of every response (random intercept + slope on quality,
    REML), all from one scan."""
    from panelkit.operators import mixed_slope

    p = clean.center(fx.responses(spark, sf_dir), "quality", "quality_c")
    design, terms = _slope_design()
    stats = mixed_slope.slope_stats(p, fx.RESPONSES, design, "participant", "quality_c")
    return mixed_slope.type3_tests(spark, mixed_slope.fit_random_slope(stats), terms)


register("random_slope_anova", "J6 B32 B33")(random_slope_anova)


def slope_pattern_sums(spark, sf_dir):
    """The sums behind the random-slope fits: per response and pattern of
    (n, sum z, sum z^2) the groups and their summed products, z = quality - 76.5
    (multiples of 1/64, as responses are quarter steps)."""
    from panelkit.operators import mixed_slope

    p = fx.responses(spark, sf_dir).withColumn("z", F.col("quality") - 76.5)
    st = mixed_slope.slope_stats(p, fx.RESPONSES, mixed.treatment_design(numeric=["z"]), "participant", "z")
    k = len(fx.RESPONSES)
    rows = st.rows.select("n", "sz", "szz", "count", _doubles("w", 2 * (2 + k)).alias("w"))
    each = rows.select("n", "sz", "szz", "count", F.explode(F.array(*[
        F.struct(F.lit(y).alias("dv"), F.col("w")[2 + j].alias("a"), F.col("w")[2 + k + 2 + j].alias("b"))
        for j, y in enumerate(fx.RESPONSES)])).alias("e")).select("n", "sz", "szz", "count", "e.*")
    out = each.groupBy("dv", "n", "sz", "szz").agg(
        F.sum("count").cast("long").alias("groups"), *[(F.round(F.sum(x) * 64) / 64).alias(c) for c, x in (
            ("yy", F.col("a") * F.col("a")), ("yz", F.col("a") * F.col("b")), ("zz", F.col("b") * F.col("b")))])
    return out.withColumns({c: F.round(c, 6) for c in ("sz", "szz")})


def _doubles(col: str, n: int):
    """A packed little-endian array of n doubles as an array column."""
    @F.pandas_udf("array<double>")
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(np.frombuffer)

    return unpack(col)


register("slope_pattern_sums", "J6 F4", fx.with_views("""
, g AS (SELECT dv, participant, count(*) AS n, sum(quality - 76.5) AS sz, sum((quality - 76.5) * (quality - 76.5)) AS szz,
               sum(y) AS a, sum(y * (quality - 76.5)) AS b
        FROM (UNPIVOT responses ON COLUMNS('item.*') INTO NAME dv VALUE y) GROUP BY ALL)
SELECT dv, CAST(n AS DOUBLE) AS n, round(CAST(sz AS DOUBLE), 6) AS sz, round(CAST(szz AS DOUBLE), 6) AS szz, count(*) AS groups,
       round(CAST(sum(a * a) AS DOUBLE) * 64) / 64 AS yy, round(CAST(sum(a * b) AS DOUBLE) * 64) / 64 AS yz, round(CAST(sum(b * b) AS DOUBLE) * 64) / 64 AS zz
FROM g GROUP BY ALL""", "responses").replace("\n, g AS", ",\ng AS"))(slope_pattern_sums)


# ------------------------------------------------------------------ J7 ordinal mixed model
#: Likert items analysed by the ordinal model, as many as in the reference.
ORDINAL_RESPONSES = fx.RESPONSES[:24]


def ordinal_mixed(spark, sf_dir):
    """Proportional-odds mixed models of 24 items with all interactions of
    both factors and quality, from one scan."""
    from panelkit.operators import ordinal

    p = clean.center(fx.responses(spark, sf_dir), "quality", "quality_c")
    p = p.select("participant", "introduction", "scenario", "quality_c", *[(F.floor(y) - 1).cast("int").alias(y) for y in ORDINAL_RESPONSES])
    cross = mixed.full_crossing(["introduction", "scenario", "quality_c"])
    design = mixed.treatment_design(numeric=["quality_c"], factors={"introduction": INTRO_LEVELS, "scenario": SCENARIO_LEVELS},
                                    interactions=cross, intercept=False)
    return ordinal.ordinal_table(spark, ordinal.fit_all(ordinal.ordinal_stats(p, ORDINAL_RESPONSES, design, "participant", 5)))


register("ordinal_mixed", "J7")(ordinal_mixed)


# ------------------------------------------------------------------ B33 three-way design columns
def design_sums_three_way(spark, sf_dir):
    """Per column of the full three-way sum-coded and treatment-coded
    designs its sum, sum of squares and product with the response."""
    r = clean_ratings(spark, sf_dir).where(F.col("introduction").isNotNull())
    fac = {"introduction": INTRO_LEVELS, "scenario": SCENARIO_LEVELS}
    cross = mixed.full_crossing(["introduction", "scenario", "quality"])
    cols = mixed.sum_design(["quality"], fac, cross)[0].terms + mixed.treatment_design(["quality"], fac, cross).terms[1:]
    y = F.col("rating").cast("double")
    aggs = [f(c).alias(f"{k}{i}") for i, (_, c) in enumerate(cols)
            for k, f in (("a", F.sum), ("b", lambda c: F.sum(c * c)), ("c", lambda c: F.sum(c * y)))]
    rows = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(n).alias("name"), F.col(f"a{i}").alias("s"),
                              F.col(f"b{i}").alias("ss"), F.col(f"c{i}").alias("sy")) for i, (n, _) in enumerate(cols)])
    wide = r.agg(*aggs)
    return wide.select(F.inline(rows)).select("col", "name", *[F.round(c, 4).alias(c) for c in ("s", "ss", "sy")])


def _design_sql():
    def ind(f, lv):
        return f"CAST({f} = '{lv}' AS DOUBLE)"

    def coded(f, levels, how):
        if how == "S":
            return [(f"C({f}, Sum)[S.{x}]", f"({ind(f, x)} - {ind(f, levels[-1])})") for x in levels[:-1]]
        return [(f"C({f})[T.{x}]", ind(f, x)) for x in levels[1:]]

    rows = []
    for how in "ST":
        i_, s_ = coded("introduction", INTRO_LEVELS, how), coded("scenario", SCENARIO_LEVELS, how)
        q = [("quality", "CAST(quality AS DOUBLE)")]
        main = q + i_ + s_ if how == "S" else i_ + s_ + q
        pairs = [(f"{a}:{b}", f"{x} * {y}") for u, v in ((i_, s_), (i_, q), (s_, q)) for a, x in u for b, y in v]
        three = [(f"{a}:{b}:{c}", f"{x} * {y} * {z}") for a, x in i_ for b, y in s_ for c, z in q]
        rows += ([("Intercept", "1.0")] if how == "S" else []) + main + pairs + three
    parts = [f"SELECT {i} AS col, '{n}' AS name, round(sum({e}), 4) AS s, round(sum(({e}) * ({e})), 4) AS ss, "
             f"round(sum(({e}) * rating), 4) AS sy FROM src" for i, (n, e) in enumerate(rows)]
    base = fx.with_views("SELECT 1", "ratings")[: -len("\nSELECT 1")]
    return base + ",\n" + CLEAN_SQL.strip() + ",\nsrc AS (SELECT * FROM clean WHERE introduction IS NOT NULL)\n" + "\nUNION ALL\n".join(parts)


register("design_sums_three_way", "B31 B32 B33", _design_sql())(design_sums_three_way)
