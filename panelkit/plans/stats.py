"""Non-parametric statistics queries (survey J8-J12, J14-J16, E3, C5)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from panelkit.operators import nonparam
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx

BETWEEN = ["introduction", "scenario"]
WITHIN = ["quality"]
SUBJECT = "participant"


def _r(df, digits=6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _fix(sql: str) -> str:
    return sql.replace("\n, ", ",\n", 1)


def _panel_signal(spark, sf_dir):
    """Panel with a quality effect: rating + (quality - 76.5)/10, clipped, quarter steps."""
    p = fx.panel(spark, sf_dir)
    return p.withColumn("rating_signal", F.round(F.least(F.lit(5.0), F.greatest(
        F.lit(1.0), F.col("rating") + (F.col("quality") - 76.5) / 10)) * 4) / 4)


PANEL_SIGNAL_SQL = ("SELECT *, round(least(5.0, greatest(1.0, rating + (quality - 76.5) / 10)) * 4) / 4 AS rating_signal "
                    "FROM panel")


# ------------------------------------------------------------------ J8 ART
def art_sql(src: str, y: str, between, within, subject, digits: int = 9, by=()) -> str:
    """DuckDB text of the ART F statistics (same algebra as
    ``nonparam.art_anova``), per group of the columns ``by`` when given."""
    factors, by = list(between) + list(within), list(by)

    def cols(*xs) -> str:
        return ", ".join([*by, *xs])

    def subsets(xs):
        for k in range(len(xs) + 1):
            yield from itertools.combinations(xs, k)

    def grouped(*xs) -> str:
        return f" GROUP BY {cols(*xs)}" if by or xs else ""

    def joined(table: str, *xs) -> str:
        return f"JOIN {table} USING ({cols(*xs)})" if by or xs else f"CROSS JOIN {table}"

    effects = [e for e in subsets(factors) if e]
    named = "".join(f"{c}, " for c in by)
    ctes = [f"cells AS (SELECT {cols(*factors)}, sum({y}) AS s, count(*) AS c FROM {src}{grouped(*factors)})"]
    for t in subsets(factors):
        name = "m_" + "_".join(t)
        ctes.append(f"{name}_t AS (SELECT {''.join(f'{c}, ' for c in [*by, *t])}sum(s) / sum(c) AS {name} FROM cells{grouped(*t)})")
    joins = " ".join(joined(f"m_{'_'.join(t)}_t", *t) for t in subsets(factors))
    ctes.append(f"means AS (SELECT * FROM cells {joins})")

    def est(e):
        return " ".join(f"{'+' if (len(e) - len(t)) % 2 == 0 else '-'} m_{'_'.join(t)}" for t in subsets(e))

    full = "m_" + "_".join(factors)
    sel = " UNION ALL ".join(
        f"SELECT '{':'.join(e)}' AS effect, {cols(subject, *factors)}, round({y} + ({est(e)}) - {full}, {digits}) AS v "
        f"FROM {src} JOIN means USING ({cols(*factors)})" for e in effects)
    ctes.append(f"aligned AS ({sel})")
    key = cols("effect")
    ctes.append(f"ranked AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY v) "
                f"+ (count(*) OVER (PARTITION BY {key}, v) - 1) / 2.0 AS r FROM aligned)")
    ctes.append(f"cell_r AS (SELECT {cols('effect', *factors)}, sum(r) AS sr, count(*) AS n FROM ranked GROUP BY {cols('effect', *factors)})")
    ctes.append(f"subj AS (SELECT {key}, sum(s * s / n) AS ss_subj, count(*) AS n_s FROM "
                f"(SELECT {cols('effect', subject)}, sum(r) AS s, count(*) AS n FROM ranked GROUP BY {cols('effect', subject)}) GROUP BY {key})")
    ctes.append(f"tot AS (SELECT {key}, sum(r * r) AS ss_rows FROM ranked GROUP BY {key})")
    ctes.append("lv AS (SELECT " + ", ".join(f"count(DISTINCT {c}) AS l_{c}" for c in factors) + " FROM cells)")
    nb = ("(SELECT count(*) FROM (SELECT DISTINCT " + ", ".join(between) + " FROM cells))") if between else "1"
    same = "".join(f" AND c.{c} = subj.{c}" for c in by)

    def margin(e, t):
        rows = f"FROM cell_r c WHERE c.effect = '{':'.join(e)}'{same}"
        if t:
            tl = ", ".join(t)
            return f"(SELECT sum(s * s / n) FROM (SELECT {tl}, sum(sr) AS s, sum(n) AS n {rows} GROUP BY {tl}))"
        return f"(SELECT sum(sr) * sum(sr) / sum(n) {rows})"

    rows = []
    for e in effects:
        ss_e = " ".join(("+ " if (len(e) - len(t)) % 2 == 0 else "- ") + margin(e, t) for t in subsets(e))
        df_e = " * ".join(f"(l_{c} - 1)" for c in e)
        if any(c in within for c in e):
            w = within[0]
            ss_err = (f"(ss_rows - ss_subj) - ({margin(e, tuple(between) + (w,))} - {margin(e, tuple(between))})")
            df_err = f"(n_s - {nb}) * (l_{w} - 1)"
        else:
            ss_err = f"ss_subj - {margin(e, tuple(between))}"
            df_err = f"(n_s - {nb})"
        rows.append(f"SELECT {''.join(f'subj.{c}, ' for c in by)}'{':'.join(e)}' AS effect, CAST({df_e} AS INT) AS df_effect, "
                    f"CAST({df_err} AS INT) AS df_error, ({ss_e}) AS ss_effect, ({ss_err}) AS ss_error "
                    f"FROM subj JOIN tot USING ({key}) CROSS JOIN lv WHERE effect = '{':'.join(e)}'")
    ctes.append("res AS (" + " UNION ALL ".join(rows) + ")")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT {named}effect, df_effect, df_error, round(ss_effect, 4) AS ss_effect, "
            "round((ss_effect / df_effect) / (ss_error / df_error), 6) AS F, "
            "round(ss_effect / (ss_effect + ss_error), 6) AS eta2_partial FROM res")


def _art_oracle(y: str, src_sql: str) -> str:
    inner = art_sql("src", y, BETWEEN, WITHIN, SUBJECT)
    base = fx.with_views(f"SELECT 1", "panel")[: -len("\nSELECT 1")]
    return base + f",\nsrc AS ({src_sql}),\n" + inner[len("WITH "):]


def art_quality(spark, sf_dir):
    p = _panel_signal(spark, sf_dir)
    a = nonparam.art_anova(p, "rating_signal", BETWEEN, WITHIN, SUBJECT)
    return a.select("effect", "df_effect", "df_error", F.round("ss_effect", 4).alias("ss_effect"),
                    F.round("F", 6).alias("F"), F.round("eta2_partial", 6).alias("eta2_partial"))


register("art_quality", "J8 F5 E4 F3", _art_oracle("rating_signal", PANEL_SIGNAL_SQL))(art_quality)


def art_null(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    a = nonparam.art_anova(p, "rating", BETWEEN, WITHIN, SUBJECT)
    return a.select("effect", "df_effect", "df_error", F.round("ss_effect", 4).alias("ss_effect"),
                    F.round("F", 6).alias("F"), F.round("eta2_partial", 6).alias("eta2_partial"))


register("art_null", "J8 F5", _art_oracle("rating", "SELECT * FROM panel"))(art_null)


def art_responses(spark, sf_dir):
    """ART of every response of the questionnaire in one pass."""
    a = nonparam.art_anova(fx.responses(spark, sf_dir), fx.RESPONSES, BETWEEN, WITHIN, SUBJECT)
    return a.select("dv", "effect", "df_effect", "df_error", F.round("ss_effect", 4).alias("ss_effect"),
                    F.round("F", 6).alias("F"), F.round("eta2_partial", 6).alias("eta2_partial"))


def _art_responses_oracle() -> str:
    base = fx.with_views("SELECT 1", "responses")[: -len("\nSELECT 1")]
    sql = art_sql("src", "y", BETWEEN, WITHIN, SUBJECT, by=["dv"])[len("WITH "):]
    return base + ",\nsrc AS (UNPIVOT responses ON COLUMNS('item.*') INTO NAME dv VALUE y),\n" + sql


register("art_responses", "J8 F5 E4", _art_responses_oracle())(art_responses)


# ------------------------------------------------------------------ J9 Dunn + Kruskal-Wallis
DUNN_BASE = """
, rk AS (SELECT scenario, rating_signal AS y,
               rank() OVER (ORDER BY rating_signal) + (count(*) OVER (PARTITION BY rating_signal) - 1) / 2.0 AS r
        FROM sig WHERE rating_signal IS NOT NULL),
g AS (SELECT scenario, count(*) AS n, avg(r) AS mr FROM rk GROUP BY 1),
t AS (SELECT sum(t * t * t - t) AS tie_sum, sum(t) AS big_n FROM (SELECT count(*) AS t FROM rk GROUP BY y))"""


def _dunn_sql(tail: str) -> str:
    base = fx.with_views("SELECT 1", "panel")[: -len("\nSELECT 1")]
    return base + f",\nsig AS ({PANEL_SIGNAL_SQL})" + DUNN_BASE.replace("\n, rk AS", ",\nrk AS") + "\n" + tail


def dunn_scenarios(spark, sf_dir):
    _, pairs = nonparam.kruskal_dunn(_panel_signal(spark, sf_dir), "rating_signal", "scenario")
    return pairs.select("level_a", "level_b", F.round("z", 6).alias("z"))


register("dunn_scenarios", "J9 C5 F6", _dunn_sql("""
SELECT a.scenario AS level_a, b.scenario AS level_b,
       round((a.mr - b.mr) / sqrt((big_n * (big_n + 1) / 12.0 - tie_sum / (12.0 * (big_n - 1))) * (1.0 / a.n + 1.0 / b.n)), 6) AS z
FROM g a JOIN g b ON a.scenario < b.scenario CROSS JOIN t"""))(dunn_scenarios)


def kruskal_scenarios(spark, sf_dir):
    h, _ = nonparam.kruskal_dunn(_panel_signal(spark, sf_dir), "rating_signal", "scenario")
    return h.select(F.round("H", 6).alias("H"), "df", "n")


register("kruskal_scenarios", "J9", _dunn_sql("""
SELECT round(12.0 / (big_n * (big_n + 1)) * sum(n * (mr - (big_n + 1) / 2.0) * (mr - (big_n + 1) / 2.0))
             / (1 - tie_sum / (big_n * big_n * big_n - big_n)), 6) AS H, count(*) - 1 AS df,
       CAST(any_value(big_n) AS BIGINT) AS n
FROM g CROSS JOIN t GROUP BY big_n, tie_sum"""))(kruskal_scenarios)


def dunn_holm(spark, sf_dir):
    """Rows-only: the Dunn pairs with two-sided p and Holm-adjusted p."""
    _, pairs = nonparam.kruskal_dunn(_panel_signal(spark, sf_dir), "rating_signal", "scenario")
    return pairs


register("dunn_holm", "J9 E3 F6")(dunn_holm)


def posthoc_scenarios(spark, sf_dir):
    p = _panel_signal(spark, sf_dir)
    _, pairs = nonparam.kruskal_dunn(p, "rating_signal", "scenario")
    return nonparam.posthoc_table(pairs, p, "rating_signal", "scenario", only_significant=False)


register("posthoc_scenarios", "J16 D1")(posthoc_scenarios)


# ------------------------------------------------------------------ J10
def spread_test(spark, sf_dir):
    bf = nonparam.brown_forsythe(fx.ratings(spark, sf_dir), "rating", "scenario")
    return bf.select("factor", "df1", "df2", F.round("F", 6).alias("F"))


register("spread_test", "J10", fx.with_views("""
, med AS (SELECT scenario, quantile_cont(rating, 0.5) AS md FROM ratings GROUP BY 1),
d AS (SELECT scenario, abs(rating - md) AS d FROM ratings JOIN med USING (scenario)),
lv AS (SELECT scenario, count(*) AS n, avg(d) AS m, sum(d * d) AS ss FROM d GROUP BY 1),
g AS (SELECT avg(d) AS gm FROM d)
SELECT 'scenario' AS factor, CAST(count(*) - 1 AS BIGINT) AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2,
       round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(ss - n * m * m) / (sum(n) - count(*))), 6) AS F
FROM lv, g""", "ratings").replace("\n, med AS", ",\nmed AS"))(spread_test)


def spread_test_p(spark, sf_dir):
    return nonparam.brown_forsythe(fx.ratings(spark, sf_dir), "rating", "scenario")


register("spread_test_p", "J10")(spread_test_p)


def residual_moments(spark, sf_dir):
    s = nonparam.residual_shape(fx.panel(spark, sf_dir), "rating", ["scenario", "quality"])
    return s.select("n", F.round("skewness", 6).alias("skewness"), F.round("excess_kurtosis", 6).alias("excess_kurtosis"))


register("residual_moments", "J10", fx.with_views("""
, m AS (SELECT scenario, quality, avg(rating) AS m FROM panel GROUP BY 1, 2),
e AS (SELECT rating - m AS e FROM panel JOIN m USING (scenario, quality)),
mo AS (SELECT count(*) AS n, avg(e) AS mu FROM e),
c AS (SELECT avg(power(e - mu, 2)) AS m2, avg(power(e - mu, 3)) AS m3, avg(power(e - mu, 4)) AS m4 FROM e, mo)
SELECT n, round(m3 / power(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS excess_kurtosis FROM mo, c""",
                                                    "panel").replace("\n, m AS", ",\nm AS"))(residual_moments)


def normality_ks(spark, sf_dir):
    return nonparam.ks_normal(fx.panel(spark, sf_dir), "rating", ["scenario", "quality"])


register("normality_ks", "J10")(normality_ks)


# ------------------------------------------------------------------ J11
ITEMS = [f"item{k}" for k in range(1, 6)]


def _with_items(df):
    return df.select("*", *[((F.col("part_key") + k * F.col("line_no")) % 7 + 1).alias(f"item{k}") for k in range(1, 6)])


def careless_screen(spark, sf_dir):
    r = _with_items(fx.ratings(spark, sf_dir))
    f = nonparam.careless_flags(r, "participant", ITEMS, pct=0.1)
    return f.select("participant", F.round("entropy", 6).alias("entropy"), "n_answers", "Suspicious")


register("careless_screen", "J11", fx.with_views("""
, a AS (SELECT participant, (part_key + k * line_no) % 7 + 1 AS ans FROM ratings, range(1, 6) t(k)),
c AS (SELECT participant, ans, count(*) AS n FROM a GROUP BY 1, 2),
t AS (SELECT participant, sum(n) AS tot FROM c GROUP BY 1),
e AS (SELECT participant, -sum(n / tot * log2(n / tot)) AS entropy, any_value(tot) AS n_answers
      FROM c JOIN t USING (participant) GROUP BY 1),
thr AS (SELECT quantile_cont(entropy, 0.1) AS thr FROM e)
SELECT participant, round(entropy, 6) AS entropy, CAST(n_answers AS BIGINT) AS n_answers,
       CASE WHEN entropy <= thr THEN 'Yes' ELSE 'No' END AS Suspicious FROM e, thr""", "ratings")
         .replace("\n, a AS", ",\na AS"))(careless_screen)


def careless_removed(spark, sf_dir):
    r = _with_items(fx.ratings(spark, sf_dir))
    kept = nonparam.remove_careless(r, "participant", ITEMS, pct=0.1)
    return kept.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


register("careless_removed", "J11 B4", fx.with_views("""
, a AS (SELECT participant, (part_key + k * line_no) % 7 + 1 AS ans FROM ratings, range(1, 6) t(k)),
c AS (SELECT participant, ans, count(*) AS n FROM a GROUP BY 1, 2),
t AS (SELECT participant, sum(n) AS tot FROM c GROUP BY 1),
e AS (SELECT participant, -sum(n / tot * log2(n / tot)) AS entropy FROM c JOIN t USING (participant) GROUP BY 1),
thr AS (SELECT quantile_cont(entropy, 0.1) AS thr FROM e),
sus AS (SELECT participant FROM e, thr WHERE entropy <= thr)
SELECT scenario, count(*) AS n FROM ratings WHERE participant NOT IN (SELECT participant FROM sus)
GROUP BY scenario""", "ratings").replace("\n, a AS", ",\na AS"))(careless_removed)


# ------------------------------------------------------------------ J12 OLS with band on a grid
def ols_band(spark, sf_dir):
    from panelkit.operators import mixed

    p = _panel_signal(spark, sf_dir)
    return mixed.ols_band(p, "rating_signal", "quality", 1, 100, with_band=False)


register("ols_band", "J12 C6", fx.with_views(f"""
, sig AS ({PANEL_SIGNAL_SQL}),
s AS (SELECT regr_slope(rating_signal, quality) AS b, regr_intercept(rating_signal, quality) AS a,
             regr_sxx(rating_signal, quality) AS sxx, regr_count(rating_signal, quality) AS n,
             avg(quality) AS xbar,
             (regr_syy(rating_signal, quality) - regr_slope(rating_signal, quality) * regr_sxy(rating_signal, quality))
               / (regr_count(rating_signal, quality) - 2) AS s2 FROM sig),
grid AS (SELECT CAST(x AS DOUBLE) AS x FROM range(1, 101) g(x))
SELECT x, round(a + b * x, 6) AS fit, round(sqrt(s2 * (1.0 / n + (x - xbar) * (x - xbar) / sxx)), 6) AS se_fit
FROM grid, s""", "panel").replace("\n, sig AS", ",\nsig AS"))(ols_band)


def ols_band_ci(spark, sf_dir):
    from panelkit.operators import mixed

    return mixed.ols_band(_panel_signal(spark, sf_dir), "rating_signal", "quality", 1, 100, with_band=True)


register("ols_band_ci", "J12")(ols_band_ci)


# ------------------------------------------------------------------ J14, J15
def effect_summary(spark, sf_dir):
    """J14 over the type III tables of the random-slope models of every
    response plus their ART tables, tagged and Holm-adjusted per response."""
    from panelkit.plans.mixed_models import random_slope_anova

    art = nonparam.art_anova(fx.responses(spark, sf_dir), fx.RESPONSES, BETWEEN, WITHIN, SUBJECT)
    return nonparam.effect_table([nonparam.art_as_effects(art), random_slope_anova(spark, sf_dir)])


register("effect_summary", "J14 B29 C4 E3 G1")(effect_summary)


def effect_sentences(spark, sf_dir):
    return nonparam.effect_sentences(effect_summary(spark, sf_dir))


register("effect_sentences", "J15")(effect_sentences)
