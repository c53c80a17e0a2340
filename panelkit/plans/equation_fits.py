"""Per-group equation queries (survey M1-M8, E6, F13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.functions.basis import FORMS
from panelkit.operators import equations, groups
from panelkit.plans.registry import register
from panelkit.plans.screening import CELL, clean_ratings, CLEAN_SQL, FLAGS_SQL
from panelkit.sources import fixtures as fx


def _r(df):
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


OUT = ["complexity", "predictor", "form", "variant", "loss", "score", "chosen"]


def _hof_out(hof, keys):
    return _r(hof.select(*keys, *OUT))


def equations_sql(src: str, keys: list[str], xs: list[str], y: str, min_rows: int = 3, parsimony: float = 1.5,
                  two_term: bool = False) -> str:
    """DuckDB text of ``fit_equations`` (+ ``fit_two_term``) + ``hall_of_fame``
    (returns CTE list ending in ``hof``)."""
    kl = ", ".join(keys)
    kc = (kl + ", ") if keys else ""
    aggs = ["count(*) AS n", f"sum({y}) AS sy", f"sum({y} * {y}) AS syy"]
    longs = []
    for p, xc in enumerate(xs):
        for i, f in enumerate(FORMS):
            e = f.sql(f"CAST({xc} AS DOUBLE)")
            aggs += [f"count({e}) AS k{p}_{i}", f"sum({e}) AS sf{p}_{i}", f"sum(({e}) * ({e})) AS sff{p}_{i}",
                     f"sum(({e}) * {y}) AS sfy{p}_{i}"]
            longs.append(f"SELECT {kc}n, sy, syy, '{xc}' AS predictor, '{f.name}' AS form, {f.complexity} AS cf, "
                         f"k{p}_{i} AS k, sf{p}_{i} AS sf, sff{p}_{i} AS sff, sfy{p}_{i} AS sfy FROM wide")
    grp = f"GROUP BY {kl}" if keys else ""
    ctes = [
        f"wide AS (SELECT {kc}{', '.join(aggs)} FROM {src} WHERE {y} IS NOT NULL {grp} HAVING count(*) >= {min_rows})",
        "lng AS (" + " UNION ALL ".join(longs) + ")",
        """c AS (SELECT *, syy - sy * sy / n AS syy_c, sff - sf * sf / n AS sff_c, sfy - sf * sy / n AS sfy_c
             FROM lng WHERE k = n)""",
        f"""fits1 AS (
  SELECT {kc}'' AS predictor, 'const' AS form, 1 AS complexity, 'const' AS variant, 0.0 AS a, sy / n AS b,
         greatest((syy - sy * sy / n) / n, 0.0) AS loss FROM wide
  UNION ALL
  SELECT {kc}predictor, form, cf + 2, 'scaled', sfy / sff, 0.0, greatest((syy - sfy / sff * sfy) / n, 0.0)
  FROM c WHERE sff > 0
  UNION ALL
  SELECT {kc}predictor, form, cf + 4, 'affine', sfy_c / sff_c, (sy - sfy_c / sff_c * sf) / n,
         greatest((syy_c - sfy_c / sff_c * sfy_c) / n, 0.0)
  FROM c WHERE sff_c > 1e-9 * greatest(sff, 1e-300))""",
    ]
    part = f"PARTITION BY {kl}" if keys else ""
    part_c = f"PARTITION BY {kc}complexity"
    ctes += _two_term_sql(src, keys, xs, y, part) if two_term else [
        f"fits AS (SELECT *, '' AS predictor2, '' AS form2 FROM fits1)"]
    ctes += [
        f"best AS (SELECT * FROM (SELECT *, row_number() OVER ({part_c} ORDER BY loss, predictor, form, variant, "
        f"predictor2, form2) AS r FROM fits) WHERE r = 1)",
        f"""pm AS (SELECT *, min(loss) OVER ({part} ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS prior_min FROM best)""",
        "front AS (SELECT * FROM pm WHERE prior_min IS NULL OR loss < prior_min)",
        f"""sc AS (SELECT *, CASE WHEN lag(loss) OVER ({part} ORDER BY complexity) IS NULL THEN 0.0
                    ELSE -(ln(greatest(loss, 1e-300)) - ln(greatest(lag(loss) OVER ({part} ORDER BY complexity), 1e-300)))
                         / (complexity - lag(complexity) OVER ({part} ORDER BY complexity)) END AS score,
                    min(loss) OVER ({part}) AS min_loss FROM front)""",
        f"""hof AS (SELECT *, row_number() OVER ({part} ORDER BY CASE WHEN loss <= {parsimony} * min_loss THEN score END
                    DESC NULLS LAST, complexity) = 1 AS chosen FROM sc)""",
    ]
    return ",\n".join(ctes)


def _two_term_sql(src: str, keys: list[str], xs: list[str], y: str, part: str) -> list[str]:
    """CTEs of ``fit_two_term`` over ``fits1``; defines ``fits`` (single +
    two-term rows, ``predictor2``/``form2`` empty for single terms)."""
    kc = (", ".join(keys) + ", ") if keys else ""
    sk = "".join(f"s.{k}, " for k in keys)
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM f.{k}" for k in keys)
    join = f"JOIN first f ON {on}" if keys else "CROSS JOIN first f"
    xg = "CASE " + " ".join(f"WHEN f.p1 = '{xc}' THEN CAST(s.{xc} AS DOUBLE)" for xc in xs) + " END"
    g = "CASE " + " ".join(f"WHEN f1 = '{fm.name}' THEN {fm.sql('xg')}" for fm in FORMS) + " END"
    aggs = ["count(*) AS n", f"sum({y}) AS sy", f"sum({y} * {y}) AS syy", "sum(g) AS sg", "sum(g * g) AS sgg",
            f"sum(g * {y}) AS sgy", "max(p1) AS p1", "max(f1) AS f1", "max(c1) AS c1"]
    longs = []
    for p, xc in enumerate(xs):
        for i, fm in enumerate(FORMS):
            e = fm.sql(f"CAST({xc} AS DOUBLE)")
            aggs += [f"count({e}) AS k{p}_{i}", f"sum({e}) AS sf{p}_{i}", f"sum(({e}) * ({e})) AS sff{p}_{i}",
                     f"sum(({e}) * {y}) AS sfy{p}_{i}", f"sum(({e}) * g) AS sfg{p}_{i}"]
            longs.append(f"SELECT {kc}n, sy, syy, sg, sgg, sgy, p1, f1, c1, '{xc}' AS predictor2, "
                         f"'{fm.name}' AS form2, {fm.complexity} AS cf, k{p}_{i} AS k, sf{p}_{i} AS sf, "
                         f"sff{p}_{i} AS sff, sfy{p}_{i} AS sfy, sfg{p}_{i} AS sfg FROM wide2")
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return [
        f"""first AS (SELECT {kc}predictor AS p1, form AS f1, complexity AS c1 FROM (
  SELECT *, row_number() OVER ({part} ORDER BY loss, predictor, form) AS r FROM fits1 WHERE variant = 'affine')
  WHERE r = 1)""",
        f"j2 AS (SELECT s.*, f.p1, f.f1, f.c1, {xg} AS xg FROM {src} s {join} WHERE s.{y} IS NOT NULL)",
        f"jg AS (SELECT *, {g} AS g FROM j2)",
        f"wide2 AS (SELECT {kc}{', '.join(aggs)} FROM jg {grp})",
        "lng2 AS (" + " UNION ALL ".join(longs) + ")",
        """c2 AS (SELECT *, sgg - sg * sg / n AS s11, sff - sf * sf / n AS s22, sfg - sf * sg / n AS s12,
             sgy - sg * sy / n AS s1y, sfy - sf * sy / n AS s2y, syy - sy * sy / n AS syc
           FROM lng2 WHERE k = n AND NOT (predictor2 = p1 AND form2 = f1))""",
        "d2 AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM c2)",
        """e2 AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS a1, (s11 * s2y - s12 * s1y) / det AS a2 FROM d2
           WHERE s22 > 1e-9 * greatest(sff, 1e-300) AND det > 1e-9 * s11 * s22)""",
        f"""fits AS (SELECT {kc}predictor, form, complexity, variant, a, b, loss, '' AS predictor2, '' AS form2, 0.0 AS a2
  FROM fits1
  UNION ALL
  SELECT {kc}p1, f1, c1 - 4 + cf + 7, 'two_term', a1, (sy - a1 * sg - a2 * sf) / n,
         greatest((syc - a1 * s1y - a2 * s2y) / n, 0.0), predictor2, form2, a2 FROM e2)""",
    ]


def _sql(src_ctes: str, keys, xs, y, tail=None, views=("ratings",)):
    base = fx.with_views("SELECT 1", *views)[: -len("\nSELECT 1")]
    kc = (", ".join(keys) + ", ") if keys else ""
    tail = tail or (f"SELECT {kc}CAST(complexity AS INT) AS complexity, predictor, form, variant, round(loss, 6) AS loss, "
                    f"round(score, 6) AS score, chosen FROM hof")
    return base + ",\n" + src_ctes + ",\n" + equations_sql("src", keys, xs, y) + "\n" + tail


SRC_CLEAN = CLEAN_SQL.strip() + ",\nsrc AS (SELECT * FROM clean)"


# ------------------------------------------------------------------ M1
def equations_by_cell(spark, sf_dir):
    r = clean_ratings(spark, sf_dir)
    fits = equations.fit_equations(r, ["introduction", "scenario"], "quality", "rating")
    return _hof_out(equations.hall_of_fame(fits, ["introduction", "scenario"]), ["introduction", "scenario"])


register("equations_by_cell", "M1 M6 E6 F13 B5", _sql(SRC_CLEAN, ["introduction", "scenario"], ["quality"],
                                                      "rating"))(equations_by_cell)


# ------------------------------------------------------------------ M2
def equations_all_rows(spark, sf_dir):
    r = clean_ratings(spark, sf_dir).withColumn("grp", F.lit("all"))
    fits = equations.fit_equations(r, ["grp"], "quality", "rating")
    return _hof_out(equations.hall_of_fame(fits, ["grp"]), ["grp"])


register("equations_all_rows", "M2 M6", _sql(CLEAN_SQL.strip() + ",\nsrc AS (SELECT *, 'all' AS grp FROM clean)",
                                             ["grp"], ["quality"], "rating"))(equations_all_rows)


# ------------------------------------------------------------------ M3
def equations_straightline(spark, sf_dir):
    r = groups.tag_equal_response(clean_ratings(spark, sf_dir), CELL, "rating")
    fits = equations.fit_equations(r, ["equal_response"], "quality", "rating")
    return _hof_out(equations.hall_of_fame(fits, ["equal_response"]), ["equal_response"])


register("equations_straightline", "M3 D4 C1 C2", _sql(
    CLEAN_SQL.strip() + "," + FLAGS_SQL + """,
src AS (SELECT c.*, coalesce(f.equal_response, false) AS equal_response FROM clean c LEFT JOIN flags f
        ON c.participant = f.participant AND c.introduction = f.introduction AND c.scenario = f.scenario)""",
    ["equal_response"], ["quality"], "rating"))(equations_straightline)


# ------------------------------------------------------------------ M4
def equations_per_participant(spark, sf_dir):
    r = clean_ratings(spark, sf_dir)
    fits = equations.fit_equations(r, ["participant"], "quality", "rating")
    return _hof_out(equations.hall_of_fame(fits, ["participant"]), ["participant"])


register("equations_per_participant", "M4 M6", _sql(SRC_CLEAN, ["participant"], ["quality"],
                                                    "rating"))(equations_per_participant)


# ------------------------------------------------------------------ M5
PREDICTORS = ["quality", "age", "line_no"]


def equations_many_predictors(spark, sf_dir):
    r = clean_ratings(spark, sf_dir).where(F.col("age").isNotNull())
    fits = equations.fit_equations(r, ["scenario"], PREDICTORS, "rating")
    return _hof_out(equations.hall_of_fame(fits, ["scenario"]), ["scenario"])


register("equations_many_predictors", "M5 M6", _sql(
    CLEAN_SQL.strip() + ",\nsrc AS (SELECT * FROM clean WHERE age IS NOT NULL)", ["scenario"], PREDICTORS,
    "rating"))(equations_many_predictors)


def equations_two_term(spark, sf_dir):
    """M5 greedy two-term search: best affine term per scenario plus every
    second (predictor, form) term, ranked in one hall of fame."""
    r = clean_ratings(spark, sf_dir).where(F.col("age").isNotNull())
    grams = equations.gram_table(r, ["scenario"], PREDICTORS, "rating")  # the only read of the rows
    fits, two = equations.fits_from_grams(grams), equations.two_terms_from_grams(grams)
    hof = equations.hall_of_fame(equations.with_two_term(fits, two), ["scenario"])
    return _r(hof.select("scenario", *OUT, "predictor2", "form2"))


def _two_term_query_sql():
    base = fx.with_views("SELECT 1", "ratings")[: -len("\nSELECT 1")]
    src = CLEAN_SQL.strip() + ",\nsrc AS (SELECT * FROM clean WHERE age IS NOT NULL)"
    tail = ("SELECT scenario, CAST(complexity AS INT) AS complexity, predictor, form, variant, round(loss, 6) AS loss, "
            "round(score, 6) AS score, chosen, predictor2, form2 FROM hof")
    return base + ",\n" + src + ",\n" + equations_sql("src", ["scenario"], PREDICTORS, "rating", two_term=True) + "\n" + tail


register("equations_two_term", "M5 M6", _two_term_query_sql())(equations_two_term)


def equations_three_terms(spark, sf_dir):
    """M5 forward selection up to three terms per scenario, from one read of the rows."""
    r = clean_ratings(spark, sf_dir).where(F.col("age").isNotNull())
    return equations.fit_forward(r, ["scenario"], PREDICTORS, "rating", terms=3)


register("equations_three_terms", "M5 M8")(equations_three_terms)


# ------------------------------------------------------------------ M7
def equations_predict(spark, sf_dir):
    r = clean_ratings(spark, sf_dir)
    keys = ["introduction", "scenario"]
    hof = equations.hall_of_fame(equations.fit_equations(r, keys, "quality", "rating"), keys)
    pred = equations.predict(r, hof, keys, "quality")
    return _r(pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                      F.avg((F.col("prediction") - F.col("rating")) ** 2).alias("mse")))


def _predict_sql():
    cases = " ".join(f"WHEN h.form = '{f.name}' THEN h.a * ({f.sql('CAST(s.quality AS DOUBLE)')}) + h.b"
                     for f in FORMS)
    tail = f"""SELECT s.introduction, s.scenario, count(*) AS n,
       round(avg(power((CASE WHEN h.form = 'const' THEN h.b {cases} END) - s.rating, 2)), 6) AS mse
FROM src s JOIN hof h ON s.introduction = h.introduction AND s.scenario = h.scenario AND h.chosen
GROUP BY 1, 2"""
    return _sql(SRC_CLEAN, ["introduction", "scenario"], ["quality"], "rating", tail=tail)


register("equations_predict", "M7", _predict_sql())(equations_predict)


def equations_predict_two_term(spark, sf_dir):
    """M7 over several predictors and two-term equations: error of each
    scenario's chosen equation on its own rows."""
    r = clean_ratings(spark, sf_dir).where(F.col("age").isNotNull())
    grams = equations.gram_table(r, ["scenario"], PREDICTORS, "rating")  # the only read of the rows
    fits, two = equations.fits_from_grams(grams), equations.two_terms_from_grams(grams)
    hof = equations.hall_of_fame(equations.with_two_term(fits, two), ["scenario"])
    # the most accurate equation of each scenario, so that two-term rows are predicted too
    best = hof.withColumn("chosen", F.col("loss") == F.min("loss").over(Window.partitionBy("scenario")))
    pred = equations.predict(r, best, ["scenario"], PREDICTORS)
    return _r(pred.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"),
                                           F.avg((F.col("prediction") - F.col("rating")) ** 2).alias("mse")))


def _predict_two_term_sql():
    def term(pred, form):
        whens = " ".join(f"WHEN h.{pred} = '{x}' AND h.{form} = '{f.name}' THEN {f.sql(f'CAST(s.{x} AS DOUBLE)')}"
                         for x in PREDICTORS for f in FORMS)
        return f"(CASE {whens} END)"

    base = fx.with_views("SELECT 1", "ratings")[: -len("\nSELECT 1")]
    src = CLEAN_SQL.strip() + ",\nsrc AS (SELECT * FROM clean WHERE age IS NOT NULL)"
    tail = f""",
top AS (SELECT * FROM (SELECT *, min(loss) OVER (PARTITION BY scenario) AS least FROM hof) WHERE loss = least)
SELECT s.scenario, count(*) AS n, round(avg(power((CASE WHEN h.form = 'const' THEN h.b
  WHEN h.variant = 'two_term' THEN h.a * {term('predictor', 'form')} + h.b + h.a2 * {term('predictor2', 'form2')}
  ELSE h.a * {term('predictor', 'form')} + h.b END) - s.rating, 2)), 6) AS mse
FROM src s JOIN top h ON s.scenario = h.scenario GROUP BY 1"""
    return base + ",\n" + src + ",\n" + equations_sql("src", ["scenario"], PREDICTORS, "rating", two_term=True) + tail


register("equations_predict_two_term", "M5 M7", _predict_two_term_sql())(equations_predict_two_term)


# ------------------------------------------------------------------ M8
def equations_text(spark, sf_dir):
    r = clean_ratings(spark, sf_dir)
    keys = ["introduction", "scenario"]
    hof = equations.hall_of_fame(equations.fit_equations(r, keys, "quality", "rating"), keys)
    return equations.equation_text(hof).select(*keys, "complexity", "loss", "score", "equation", "chosen")


register("equations_text", "M8 A9")(equations_text)
