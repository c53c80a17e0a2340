"""Result-table queries whose inputs are given tables of terms, p values and
intervals derived from the data (survey E3, E8, B29, B30, C4, D20, J14, J15,
J16, F-1 to F-5, G2, G3, A4), so that each has an exact oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.operators import clean, encode, explain, groups, metrics, nonparam, ranks
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx
from panelkit.sources import tables

TERMS = ("introduction", "quality", "introduction:quality", "introduction:quality:line_no")


def _given(spark, sf_dir):
    """One row per (dv = scenario, term): deterministic p, F, df and interval."""
    base = fx.ratings(spark, sf_dir).groupBy(F.col("scenario").alias("dv")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("part_key") * 3 + F.col("line_no")).cast("long").alias("s"))
    rows = base.select("dv", "n", "s", F.posexplode(F.array(*[F.lit(t) for t in TERMS])).alias("i", "term"))
    k = F.pmod(F.col("s") + F.col("i") * 7919, F.lit(1000)).cast("double")
    lo = (k - 500) / 250
    return rows.select("dv", "term", (k / 5000).alias("p"), (k / 100 + 0.25).alias("F"),
                       (F.col("i") + 1).cast("int").alias("NumDF"), F.col("n").cast("double").alias("DenDF"),
                       lo.alias("lo"), (lo + 1.5).alias("hi"))


_GIVEN = "given AS (SELECT dv, term, k / 5000 AS p, k / 100 + 0.25 AS F, CAST(i + 1 AS INT) AS NumDF, " \
    "CAST(n AS DOUBLE) AS DenDF, (k - 500) / 250 AS lo, (k - 500) / 250 + 1.5 AS hi FROM (" \
    "SELECT scenario AS dv, term, i, n, CAST((s + i * 7919) % 1000 AS DOUBLE) AS k FROM " \
    "(SELECT scenario, count(*) AS n, CAST(sum(part_key * 3 + line_no) AS BIGINT) AS s FROM ratings GROUP BY 1), (VALUES " \
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ") t(i, term)))"
_HOLM = """holm AS (SELECT *, least(1.0, max((m - r + 1) * p) OVER (PARTITION BY dv ORDER BY r)) AS p_holm FROM (
  SELECT *, count(p) OVER (PARTITION BY dv) AS m, row_number() OVER (PARTITION BY dv ORDER BY p, term) AS r FROM given))"""
_TYPE = """CASE length(term) - length(replace(term, ':', '')) WHEN 0 THEN 'main' WHEN 1 THEN 'two-way' ELSE 'three-way' END"""


def _sql(select: str, *ctes: str) -> str:
    base = fx.with_views("SELECT 1", "ratings")[: -len("\nSELECT 1")]
    return base + ",\n" + ",\n".join((_GIVEN, *ctes)) + "\n" + select


def _r(df, d=6):
    return df.select(*[F.round(F.col(c), d).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def holm_adjusted(spark, sf_dir):
    """Holm within each response."""
    return _r(ranks.holm(_given(spark, sf_dir), "p", by=["dv"], tiebreak=["term"]).select("dv", "term", "p_holm"))


register("holm_adjusted", "E3", _sql("SELECT dv, term, round(p_holm, 6) AS p_holm FROM holm", _HOLM))(holm_adjusted)


def effect_tags(spark, sf_dir):
    """Effect type of a term and whether its interval excludes 0."""
    g = _given(spark, sf_dir)
    return g.select("dv", "term", encode.effect_type("term").alias("effect_type"),
                    encode.ci_excludes_zero("lo", "hi").alias("excludes_zero"))


register("effect_tags", "B29 B30", _sql(
    f"SELECT dv, term, {_TYPE} AS effect_type, lo > 0 OR hi < 0 AS excludes_zero FROM given"))(effect_tags)


def _effects(spark, sf_dir):
    g = _given(spark, sf_dir)
    names = [r["dv"] for r in g.select("dv").distinct().orderBy("dv").collect()]  # one name per response
    parts = {n: g.where(F.col("dv") == n).drop("dv", "lo", "hi") for n in names}
    # no size for the three-way term: the left join keeps it with a null
    sizes = g.where("term <> 'introduction:quality:line_no'").select("dv", "term", (F.col("lo") * F.col("lo")).alias("size"))
    return nonparam.effect_table(parts, sizes)


def effect_table_given(spark, sf_dir):
    """Union of the responses' tables, sizes joined by term, tagged,
    Holm-adjusted."""
    return _r(_effects(spark, sf_dir).select("dv", "term", "F", "p", "size", "effect_type", "p_holm_within_dv", "significant"))


register("effect_table_given", "J14 C4 G1 E3 B29", _sql(
    f"""SELECT dv, term, round(F, 6) AS F, round(p, 6) AS p,
  CASE WHEN term <> 'introduction:quality:line_no' THEN round(lo * lo, 6) END AS size, {_TYPE} AS effect_type,
  round(p_holm, 6) AS p_holm_within_dv, p < 0.05 AS significant FROM holm""", _HOLM))(effect_table_given)


def effect_sentences_given(spark, sf_dir):
    """The sentence of every response with a significant effect."""
    return nonparam.effect_sentences(_effects(spark, sf_dir))


register("effect_sentences_given", "J15", _sql(
    f"""SELECT dv, CASE WHEN k = 2 AND mains = 2 THEN 'For ' || dv || ', both main effects were significant: '
    || replace(txt, '; ', ' and ') || '.' ELSE 'For ' || dv || ', significant effects: ' || txt || '.' END AS sentence
FROM (SELECT dv, count(*) AS k, count(*) FILTER (WHERE {_TYPE} = 'main') AS mains,
   string_agg(printf('%s (F(%d, %.1f) = %.2f, p = %.3f)', term, NumDF, DenDF, F, p), '; ' ORDER BY term) AS txt
   FROM given WHERE p < 0.05 GROUP BY dv)"""))(effect_sentences_given)


def posthoc_given(spark, sf_dir):
    """Given pairs joined to the mean and sd of both levels."""
    r = fx.ratings(spark, sf_dir)
    g = _given(spark, sf_dir).where("term = 'quality'").select("dv", F.col("F").alias("z"), "p")
    pairs = g.select(F.col("dv").alias("level_a"), "z", "p", (F.col("p") * 2).alias("p_holm")) \
        .join(g.select(F.col("dv").alias("level_b")), F.col("level_a") < F.col("level_b"))
    return _r(nonparam.posthoc_table(pairs, r, "rating", "scenario", only_significant=False))


register("posthoc_given", "J16 D1", _sql(
    """SELECT a.dv AS level_a, b.dv AS level_b, round(sa.mean, 6) AS mean_a, round(sa.sd, 6) AS sd_a,
  round(sb.mean, 6) AS mean_b, round(sb.sd, 6) AS sd_b, round(a.F, 6) AS z, round(a.p, 6) AS p, round(a.p * 2, 6) AS p_holm
FROM given a JOIN given b ON a.dv < b.dv AND a.term = 'quality' AND b.term = 'quality'
JOIN st sa ON sa.scenario = a.dv JOIN st sb ON sb.scenario = b.dv""",
    "st AS (SELECT scenario, avg(rating) AS mean, stddev_samp(rating) AS sd FROM ratings GROUP BY 1)"))(posthoc_given)


def best_so_far(spark, sf_dir):
    """Per run, the epochs that improve the validation loss."""
    h = fx.ratings(spark, sf_dir).groupBy("scenario", F.pmod("part_key", F.lit(40)).cast("int").alias("epoch")) \
        .agg(F.avg("quality").alias("loss"))
    return _r(metrics.best_so_far(h, "epoch", "loss", by=["scenario"]))


register("best_so_far", "E8", _sql(
    """SELECT scenario, epoch, round(loss, 6) AS loss, round(least(loss, coalesce(before, loss)), 6) AS best,
  before IS NULL OR loss < before AS improved FROM (SELECT *, min(loss) OVER (PARTITION BY scenario ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)""",
    "h AS (SELECT scenario, CAST(part_key % 40 AS INT) AS epoch, avg(quality) AS loss FROM ratings GROUP BY 1, 2)"))(best_so_far)


def mean_abs_by_term(spark, sf_dir):
    """D20, F-2: mean absolute value per term, the two largest in order."""
    m = _r(explain.mean_abs(_given(spark, sf_dir), "lo", ["term"]))  # rounded first: equal means are ties
    top = m.orderBy(F.col("mean_abs_lo").desc(), "term").limit(2)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_abs_lo").desc(), "term")))


register("mean_abs_by_term", "D20 F-2", _sql(
    """SELECT term, m AS mean_abs_lo, CAST(row_number() OVER (ORDER BY m DESC, term) AS INT) AS place
FROM (SELECT term, round(avg(abs(lo)), 6) AS m FROM given GROUP BY 1) ORDER BY m DESC, term LIMIT 2"""))(mean_abs_by_term)


def sorted_places(spark, sf_dir):
    """F-1, F-3, F-4: places of every participant's mean rating in descending
    order of the mean, in order of x (mean quality), and in input order."""
    p = fx.ratings(spark, sf_dir).groupBy("participant").agg(
        F.avg("rating").alias("m"), F.avg("quality").alias("x"), F.min("row_id").alias("first_row"))
    p = p.withColumn("down", -F.col("m"))
    for order, out in (("down", "place_desc"), ("x", "place_x"), ("first_row", "place_input")):
        p = ranks.row_number(p, [order, "participant"], out=out)
    return p.select("participant", "place_desc", "place_x", "place_input")


register("sorted_places", "F-1 F-3 F-4 E9", _sql(
    """SELECT participant, row_number() OVER (ORDER BY -m, participant) AS place_desc,
  row_number() OVER (ORDER BY x, participant) AS place_x, row_number() OVER (ORDER BY f, participant) AS place_input
FROM (SELECT participant, avg(rating) AS m, avg(quality) AS x, min(row_id) AS f FROM ratings GROUP BY 1)"""))(sorted_places)


def ordered_levels(spark, sf_dir):
    """F-5: level lists of the factors in order, as a table."""
    r = fx.ratings(spark, sf_dir)
    return encode.level_table(spark, encode.fit_levels(r, ["scenario", "introduction_raw"]))


register("ordered_levels", "F-5", _sql(
    """SELECT feature, level, CAST(row_number() OVER (PARTITION BY feature ORDER BY level) - 1 AS INT) AS ord FROM (
SELECT DISTINCT 'scenario' AS feature, scenario AS level FROM ratings WHERE scenario IS NOT NULL
UNION SELECT DISTINCT 'introduction_raw', introduction_raw FROM ratings WHERE introduction_raw IS NOT NULL)"""))(ordered_levels)


def distinct_pairs(spark, sf_dir):
    """Distinct (participant, scenario) pairs, counted per scenario."""
    d = groups.distinct_rows(fx.ratings(spark, sf_dir), ["participant", "scenario"])
    return d.groupBy("scenario").agg(F.count(F.lit(1)).alias("pairs"))


register("distinct_pairs", "G2", _sql(
    "SELECT scenario, count(*) AS pairs FROM (SELECT DISTINCT participant, scenario FROM ratings) GROUP BY 1"))(distinct_pairs)


def guards(spark, sf_dir):
    """What the missing-path guard and the name difference report,
    beside the rows of the table that is there."""
    try:
        tables.read_table(spark, f"{sf_dir}/no_such_table.parquet")
        missing = False
    except FileNotFoundError:
        missing = True
    orders = tables.read_table(spark, f"{sf_dir}/orders.parquet")
    lacking = groups.name_difference(["o_orderkey", "o_colour", "o_age"], orders.columns)
    return orders.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(missing).alias("missing_path"),
                      F.lit(",".join(lacking)).alias("lacking"))


register("guards", "A4 G3", "SELECT count(*) AS n_rows, true AS missing_path, 'o_age,o_colour' AS lacking FROM orders")(guards)


def number_casts(spark, sf_dir):
    """Text to numbers, bad text to null (lenient); the good rows again
    under the strict cast."""
    t = fx.ratings(spark, sf_dir).select("scenario", F.when(F.col("part_key") % 7 == 0, "n/a").otherwise(
        F.concat(F.lit(" "), F.col("line_no").cast("string"), F.lit(".50"))).alias("txt"))
    soft = clean.to_number(t, ["txt"], strict=False).groupBy("scenario").agg(
        F.count("txt").alias("n_numbers"), F.count_if(F.col("txt").isNull()).alias("n_bad"), F.sum("txt").alias("total"))
    hard = clean.to_number(t.where("txt <> 'n/a'"), ["txt"]).groupBy("scenario").agg(F.max("txt").alias("largest"))
    return soft.join(hard, "scenario")


register("number_casts", "B12", _sql(
    """SELECT scenario, count(x) AS n_numbers, count(*) FILTER (WHERE x IS NULL) AS n_bad, sum(x) AS total, max(x) AS largest
FROM (SELECT scenario, CASE WHEN part_key % 7 <> 0 THEN CAST(line_no AS DOUBLE) + 0.5 END AS x FROM ratings) GROUP BY 1""")
         )(number_casts)


def outliers_zero_mad(spark, sf_dir):
    """C10 with groups whose MAD is 0: they keep all their rows."""
    r = fx.ratings(spark, sf_dir).select("scenario", F.when(
        F.col("scenario") == "3Spurig", F.when(F.col("part_key") % 9 == 0, F.col("quality")).otherwise(1.0))
        .otherwise(F.col("quality") * F.when(F.col("part_key") % 11 == 0, 40).otherwise(1)).cast("double").alias("v"))
    return clean.remove_group_outliers(r, "scenario", "v").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("largest"))


register("outliers_zero_mad", "C10", _sql(
    """SELECT scenario, count(*) AS n, max(v) AS largest FROM v JOIN md USING (scenario) JOIN mad USING (scenario)
WHERE mad = 0 OR abs(v - m) / (1.4826 * CASE WHEN mad = 0 THEN 1 ELSE mad END) <= 3 GROUP BY 1""",
    """v AS (SELECT scenario, CAST(CASE WHEN scenario = '3Spurig' THEN CASE WHEN part_key % 9 = 0 THEN quality ELSE 1.0 END
  ELSE quality * CASE WHEN part_key % 11 = 0 THEN 40 ELSE 1 END END AS DOUBLE) AS v FROM ratings)""",
    "md AS (SELECT scenario, quantile_cont(v, 0.5) AS m FROM v GROUP BY 1)",
    "mad AS (SELECT scenario, quantile_cont(abs(v - m), 0.5) AS mad FROM v JOIN md USING (scenario) GROUP BY 1)"))(outliers_zero_mad)


def mode_mae(spark, sf_dir):
    """Error of a mode prediction."""
    r = fx.ratings(spark, sf_dir).withColumn("mode", (F.col("part_key") % 5 + 1).cast("double"))
    return _r(metrics.mode_mae(r, "rating", "mode").select("mae"))


register("mode_mae", "D9", _sql("SELECT round(avg(abs(rating - (part_key % 5 + 1))), 6) AS mae FROM ratings"))(mode_mae)
