"""Split, sampling and resampling queries (survey 2.H, C3, C8, D24, F-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions.random import uniform_sql
from panelkit.operators import split
from panelkit.plans.encoding import group_split_sql
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx


def _r6(df):
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _fix(sql: str) -> str:
    return sql.replace("\n, ", ",\n", 1)


# ------------------------------------------------------------------ H1
def random_split_sizes(spark, sf_dir):
    r = split.random_split(fx.ratings(spark, sf_dir), "row_id", test=0.2, seed=42)
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"))


register("random_split_sizes", "H1", fx.with_views(f"""
SELECT CASE WHEN {uniform_sql('42', 'row_id')} < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       sum(rating) AS sum_rating
FROM ratings GROUP BY 1""", "ratings"))(random_split_sizes)


# ------------------------------------------------------------------ H2, C3
def group_split_sizes(spark, sf_dir):
    r = split.group_split(fx.ratings(spark, sf_dir), "participant", test=0.2, seed=42)
    per = r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("participant").alias("n_groups"),
                                 F.sum("rating").alias("sum_rating"))
    both = (r.groupBy("participant").agg(F.count_distinct("split").alias("k")).where(F.col("k") > 1)
            .agg(F.count(F.lit(1)).alias("n_on_both_sides")))
    return per.crossJoin(both)


register("group_split_sizes", "H2 C3", _fix(fx.with_views(f"""
, {group_split_sql('ratings', 'participant').strip()},
r AS (SELECT ratings.*, split FROM ratings LEFT JOIN gsplit USING (participant)),
b AS (SELECT count(*) AS n_on_both_sides FROM (SELECT participant FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1))
SELECT split, count(*) AS n, count(DISTINCT participant) AS n_groups, sum(rating) AS sum_rating,
       any_value(n_on_both_sides) AS n_on_both_sides
FROM r, b GROUP BY split""", "ratings")))(group_split_sizes)


# ------------------------------------------------------------------ H3, E9
def exact_split_sizes(spark, sf_dir):
    r = split.exact_split(fx.ratings(spark, sf_dir), "row_id", (0.8, 0.1, 0.1), seed=1337)
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"),
                                  F.sum("quality").alias("sum_quality"))


register("exact_split_sizes", "H3 E9", _fix(fx.with_views(f"""
, n AS (SELECT row_id, rating, quality, row_number() OVER (ORDER BY {uniform_sql('1337', 'row_id')}, row_id) AS rn,
              count(*) OVER () AS total FROM ratings)
SELECT CASE WHEN rn <= floor(total * 0.8) THEN 'train'
            WHEN rn <= floor(total * 0.8) + floor(total * 0.1) THEN 'valid' ELSE 'test' END AS split,
       count(*) AS n, sum(rating) AS sum_rating, sum(quality) AS sum_quality
FROM n GROUP BY 1""", "ratings")))(exact_split_sizes)


# ------------------------------------------------------------------ H4, F-6
def sampled_rows(spark, sf_dir):
    s = split.sample_n(fx.ratings(spark, sf_dir), 50, "row_id", by=["scenario"], seed=42)
    return s.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"),
                                     F.min("row_id").alias("first_id"))


register("sampled_rows", "H4 F-6", _fix(fx.with_views(f"""
, s AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {uniform_sql('42', 'row_id')}, row_id) AS rn
        FROM ratings)
SELECT scenario, count(*) AS n, sum(rating) AS sum_rating, min(row_id) AS first_id FROM s WHERE rn <= 50
GROUP BY scenario""", "ratings")))(sampled_rows)


def sampled_global(spark, sf_dir):
    return split.sample_n(fx.ratings(spark, sf_dir), 25, "row_id", seed=7).select("row_id", "participant", "rating")


register("sampled_global", "H4 F-6", fx.with_views(f"""
SELECT row_id, participant, rating FROM ratings ORDER BY {uniform_sql('7', 'row_id')}, row_id LIMIT 25""",
                                                   "ratings"))(sampled_global)


# ------------------------------------------------------------------ H5, D24 (Poisson weights)
B = 1000


def _poisson_sql(u: str) -> str:
    cdf = split.poisson1_cdf()
    whens = " ".join(f"WHEN {u} < {repr(c)} THEN {k}" for k, c in enumerate(cdf))
    return f"CASE {whens} ELSE {len(cdf)} END"


def bootstrap_row_weights(spark, sf_dir):
    """H5 row-level hashed Poisson(1) weights (the form for continuous data):
    replicate means per scenario on the panel, percentile band."""
    r = fx.panel(spark, sf_dir).withColumn("row_id", F.concat_ws("|", "participant",
                                                                 F.col("quality").cast("string")))
    w = split.bootstrap_weights(r.select("row_id", "scenario", "rating"), "row_id", B, seed=42)
    reps = w.groupBy("scenario", "b").agg((F.sum(F.col("w") * F.col("rating")) / F.sum("w")).alias("m"))
    band = reps.groupBy("scenario").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    mean = r.groupBy("scenario").agg(F.avg("rating").alias("mean"))
    return _r6(mean.join(band, "scenario"))


register("bootstrap_row_weights", "H5 D24", _fix(fx.with_views(f"""
, pr AS (SELECT participant || '|' || CAST(quality AS VARCHAR) AS row_id, scenario, rating FROM panel),
w AS (SELECT scenario, b, rating, {_poisson_sql(uniform_sql('42', 'b', 'row_id').replace('row_id', 'rid'))} AS w
      FROM (SELECT r.scenario, r.rating, r.row_id AS rid, b.b FROM pr r, range(1, {B + 1}) b(b))),
m AS (SELECT scenario, b, sum(w * rating) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1, 2),
band AS (SELECT scenario, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)
SELECT scenario, round(avg(rating), 6) AS mean, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi
FROM pr JOIN band USING (scenario) GROUP BY scenario""", "panel")))(bootstrap_row_weights)


def bootstrap_cell_means(spark, sf_dir, replicates: int = 1000):
    """D24 (mean_cl_boot) on the whole rating table: ratings are discrete, so
    rows are counted per (cell, value) first and each replicate draws one
    Poisson(n) weight per count - the same distribution as per-row Poisson
    weights at (cells x values x replicates) cost instead of rows x replicates."""
    r = fx.ratings(spark, sf_dir)
    cells = ["introduction_raw", "scenario"]
    counts = r.groupBy(*cells, "rating").agg(F.count(F.lit(1)).alias("n"))
    w = split.poisson_replicate_counts(counts, "n", cells + ["rating"], replicates, seed=42)
    reps = w.groupBy(*cells, "b").agg((F.sum(F.col("w") * F.col("rating")) / F.sum("w")).alias("m"))
    band = reps.groupBy(*cells).agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"))
    mean = counts.groupBy(*cells).agg((F.sum(F.col("n") * F.col("rating")) / F.sum("n")).alias("mean"),
                                      F.sum("n").alias("n"))
    return mean.join(band, cells)


register("bootstrap_cell_means", "D24 H5")(bootstrap_cell_means)


# ------------------------------------------------------------------ H5 exact draws, C8
def bootstrap_draw_sizes(spark, sf_dir):
    p = fx.panel(spark, sf_dir).select("participant", "quality", "scenario", "rating")
    d = split.bootstrap_draws(p, "participant", ["scenario", "quality"], 20, seed=3)
    return d.groupBy("scenario", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"))


register("bootstrap_draw_sizes", "H5 C8", _fix(fx.with_views(f"""
, num AS (SELECT *, row_number() OVER (PARTITION BY scenario, quality ORDER BY participant) AS idx,
                count(*) OVER (PARTITION BY scenario, quality) AS n FROM panel),
sz AS (SELECT DISTINCT scenario, quality, n FROM num),
dr AS (SELECT sz.scenario, sz.quality, b.b, d.d FROM sz, range(1, 21) b(b), range(1, sz.n + 1) d(d)),
ix AS (SELECT scenario, quality, b, CAST(floor({uniform_sql('3', 'b', 'd', 'scenario', 'quality')} * n) + 1 AS BIGINT) AS idx
       FROM dr JOIN sz USING (scenario, quality))
SELECT scenario, CAST(b AS INT) AS b, count(*) AS n, sum(rating) AS sum_rating
FROM ix JOIN num USING (scenario, quality, idx) GROUP BY 1, 2""", "panel")))(bootstrap_draw_sizes)


# ------------------------------------------------------------------ H6
def permutation_fixed_points(spark, sf_dir):
    p = fx.panel(spark, sf_dir).withColumn("key", F.concat_ws("|", "participant", F.col("quality").cast("string")))
    m = split.permutation_map(p, "key", ["quality", "scenario"], 3, seed=42)
    return m.groupBy("feature", "repeat").agg(F.count(F.lit(1)).alias("n"),
                                              F.count_distinct("source_key").alias("n_sources"),
                                              F.count_if(F.col("key") == F.col("source_key")).alias("n_fixed"),
                                              F.min(F.when(F.col("key") == F.lit("P1|67.0"), F.col("source_key")))
                                              .alias("source_of_first"))


register("permutation_fixed_points", "H6", _fix(fx.with_views(f"""
, a AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n
        FROM (SELECT participant || '|' || CAST(quality AS VARCHAR) AS key FROM panel)),
x AS (SELECT key, feature, repeat, {split.bijection_sql('i', 'n', 'keys')} AS i
      FROM a, (VALUES {', '.join(f"('{f}', {r}, {split.bijection_keys(42, f, r)}::BIGINT[])" for f in ('quality', 'scenario') for r in (1, 2, 3))})
              c(feature, repeat, keys)),
m AS (SELECT x.feature, x.repeat, x.key, a.key AS source_key FROM x JOIN a USING (i))
SELECT feature, CAST(repeat AS INT) AS repeat, count(*) AS n, count(DISTINCT source_key) AS n_sources,
       CAST(count_if(key = source_key) AS BIGINT) AS n_fixed,
       min(CASE WHEN key = 'P1|67.0' THEN source_key END) AS source_of_first
FROM m GROUP BY 1, 2""", "panel")))(permutation_fixed_points)
