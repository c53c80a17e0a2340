"""Scan / sink queries (survey A2-A7, A9). Written tables go to a unique
folder under the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelkit.operators import equations, groups, nonparam
from panelkit.plans.registry import register
from panelkit.plans.screening import CLEAN_SQL, clean_ratings
from panelkit.plans.stats import ITEMS, _with_items
from panelkit.session import ensure_checkpoint_dir
from panelkit.sources import fixtures as fx
from panelkit.sources import tables


def _scratch(spark, what: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{what}-{uuid.uuid4().hex}"


RATING_COLS = ["row_id", "participant", "introduction_raw", "scenario", "quality", "rating"]


def variant_scan(spark, sf_dir):
    """A2 (+A1, A3, A7, J11): the rating table and its screened copy written
    as parquet, scanned back as two variants tagged by file stem."""
    r = _with_items(fx.ratings(spark, sf_dir))
    screened = nonparam.remove_careless(r, "participant", ITEMS, pct=0.1)
    root = _scratch(spark, "variants")
    tables.write_parquet(r.select(*RATING_COLS), f"{root}/ratings.parquet")
    tables.write_parquet(screened.select(*RATING_COLS), f"{root}/ratings_screened.parquet")
    both = tables.read_variants(spark, [f"{root}/ratings.parquet", f"{root}/ratings_screened.parquet"])
    tables.require_columns(both, RATING_COLS + ["variant"])
    return both.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"))


register("variant_scan", "A1 A2 A3 A7 G1 J11", fx.with_views("""
, a AS (SELECT participant, (part_key + k * line_no) % 7 + 1 AS ans FROM ratings, range(1, 6) t(k)),
c AS (SELECT participant, ans, count(*) AS n FROM a GROUP BY 1, 2),
t AS (SELECT participant, sum(n) AS tot FROM c GROUP BY 1),
e AS (SELECT participant, -sum(n / tot * log2(n / tot)) AS entropy FROM c JOIN t USING (participant) GROUP BY 1),
thr AS (SELECT quantile_cont(entropy, 0.1) AS thr FROM e),
sus AS (SELECT participant FROM e, thr WHERE entropy <= thr)
SELECT 'ratings' AS variant, count(*) AS n, sum(rating) AS sum_rating FROM ratings
UNION ALL
SELECT 'ratings_screened', count(*), sum(rating) FROM ratings WHERE participant NOT IN (SELECT participant FROM sus)""",
                                                "ratings").replace("\n, a AS", ",\na AS"))(variant_scan)


def csv_roundtrip(spark, sf_dir):
    """A5: a cell summary written as CSV with 4 decimals and read back with
    an explicit schema."""
    summary = groups.cell_summary(fx.panel(spark, sf_dir), ["scenario", "quality"], "rating")
    path = _scratch(spark, "cell_summary") + ".csv"
    tables.write_csv(summary, path, digits=4)
    return tables.read_table(spark, path, "scenario string, quality double, n long, mean double, sd double", fmt="csv")


register("csv_roundtrip", "A5 D1", fx.with_views("""
SELECT scenario, quality, count(rating) AS n, round(avg(rating), 4) AS mean, round(stddev_samp(rating), 4) AS sd
FROM panel GROUP BY 1, 2""", "panel"))(csv_roundtrip)


def json_roundtrip(spark, sf_dir):
    """Metric rows written as JSON documents and read back."""
    r = fx.ratings(spark, sf_dir)
    m = r.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.max("rating").alias("max_rating"))
    path = _scratch(spark, "metrics") + ".json"
    tables.write_json(m, path)
    return spark.read.schema("scenario string, n long, max_rating double").json(path)


register("json_roundtrip", "A6", fx.with_views(
    "SELECT scenario, count(*) AS n, max(rating) AS max_rating FROM ratings GROUP BY 1", "ratings"))(json_roundtrip)


def hall_of_fame_table(spark, sf_dir):
    """Per-group equation lists written partitioned by the group key and
    read back (Complexity, Loss, Equation per fit)."""
    r = clean_ratings(spark, sf_dir)
    keys = ["introduction", "scenario"]
    hof = equations.equation_text(equations.hall_of_fame(equations.fit_equations(r, keys, "quality", "rating"), keys))
    out = hof.select(*keys, F.col("complexity").alias("Complexity"), F.round("loss", 6).alias("Loss"),
                     F.col("equation").alias("Equation"))
    path = _scratch(spark, "hall_of_fame")
    tables.write_parquet(out, path, partition_by=keys)
    back = spark.read.parquet(path)
    return back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_equations"), F.min("Loss").alias("best_loss"))


def _hof_sql():
    from panelkit.plans.equation_fits import equations_sql

    base = fx.with_views("SELECT 1", "ratings")[: -len("\nSELECT 1")]
    return (base + ",\n" + CLEAN_SQL.strip() + ",\nsrc AS (SELECT * FROM clean),\n"
            + equations_sql("src", ["introduction", "scenario"], ["quality"], "rating")
            + "\nSELECT introduction, scenario, count(*) AS n_equations, min(round(loss, 6)) AS best_loss FROM hof "
              "GROUP BY 1, 2")


register("hall_of_fame_table", "A9 M6 M8", _hof_sql())(hall_of_fame_table)
