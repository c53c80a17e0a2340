"""Smoothed-curve queries (survey L7, F14, D24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import smooth
from panelkit.plans.registry import register
from panelkit.plans.screening import CLEAN_SQL, clean_ratings
from panelkit.sources import fixtures as fx


def kernel_curves(spark, sf_dir):
    r = clean_ratings(spark, sf_dir)
    c = smooth.kernel_curve(r, "quality", "rating", ["scenario", "introduction"], points=80)
    return c.select("scenario", "introduction", "grid_index", F.round("g", 6).alias("g"),
                    F.round("curve", 6).alias("curve"))


def _curve_sql():
    base = fx.with_views("SELECT 1", "ratings")[: -len("\nSELECT 1")]
    return base + ",\n" + CLEAN_SQL.strip() + """,
rng AS (SELECT min(quality) AS lo, max(quality) AS hi, greatest((max(quality) - min(quality)) / 8.0, 0.5) AS h FROM clean),
grid AS (SELECT i AS grid_index, lo + (hi - lo) * i / 79 AS g, h FROM rng, range(0, 80) t(i)),
st AS (SELECT scenario, introduction, quality AS x, count(*) AS n, sum(rating) AS sy FROM clean GROUP BY 1, 2, 3),
cells AS (SELECT scenario, introduction, count(*) AS cn, avg(rating) AS cm FROM clean GROUP BY 1, 2),
cv AS (SELECT scenario, introduction, grid_index, g,
              sum(exp(-0.5 * ((g - x) / h) * ((g - x) / h)) * sy) AS num,
              sum(exp(-0.5 * ((g - x) / h) * ((g - x) / h)) * n) AS den
       FROM st, grid GROUP BY 1, 2, 3, 4)
SELECT scenario, introduction, grid_index, round(g, 6) AS g,
       round(CASE WHEN cn < 5 THEN cm ELSE num / CASE WHEN den = 0 THEN 1 ELSE den END END, 6) AS curve
FROM cv JOIN cells USING (scenario, introduction)"""


register("kernel_curves", "L7 F14 C6", _curve_sql())(kernel_curves)


def kernel_curve_bands(spark, sf_dir):
    r = clean_ratings(spark, sf_dir)
    return smooth.kernel_curve_band(r, "quality", "rating", ["scenario", "introduction"], replicates=1000)


register("kernel_curve_bands", "L7 H5 D24")(kernel_curve_bands)


BINS = 200


def kernel_curves_binned(spark, sf_dir):
    """L7 for continuous x: target over account balance per market segment, on linear bins."""
    c = smooth.kernel_curve(fx.signal(spark, sf_dir), "c_acctbal", "target", ["c_mktsegment"], bins=BINS)
    return c.select("c_mktsegment", "grid_index", F.round("g", 5).alias("g"), F.round("curve", 6).alias("curve"))


register("kernel_curves_binned", "L7 F14", fx.with_views(f"""
, rng AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, greatest((max(c_acctbal) - min(c_acctbal)) / 8.0, 0.5) AS h FROM signal),
grid AS (SELECT i AS grid_index, lo + (hi - lo) * i / 79 AS g FROM rng, range(0, 80) t(i)),
p AS (SELECT c_mktsegment, target, (c_acctbal - lo) / (hi - lo) * {BINS} AS p FROM signal, rng),
e AS (SELECT c_mktsegment, target, floor(p) AS k, 1 - (p - floor(p)) AS s FROM p UNION ALL SELECT c_mktsegment, target, floor(p) + 1, p - floor(p) FROM p),
b AS (SELECT c_mktsegment, k, sum(s) AS n, sum(s * target) AS sy FROM e WHERE s > 0 GROUP BY 1, 2),
w AS (SELECT c_mktsegment, grid_index, g, n, sy, (g - (lo + (hi - lo) * k / {BINS})) / h AS z FROM b, grid, rng)
SELECT c_mktsegment, grid_index, round(g, 5) AS g, round(sum(exp(-0.5 * z * z) * sy) / sum(exp(-0.5 * z * z) * n), 6) AS curve
FROM w WHERE abs(z) <= {smooth.TAIL} GROUP BY c_mktsegment, grid_index, g""", "signal").replace("\n\n, rng AS", ",\nrng AS")
         .replace("\n, rng AS", ",\nrng AS"))(kernel_curves_binned)


def kernel_bands_binned(spark, sf_dir):
    """The same with bootstrap bands of 1,000 replicates."""
    return smooth.kernel_curve_band(fx.signal(spark, sf_dir), "c_acctbal", "target", ["c_mktsegment"], replicates=1000, bins=40)


register("kernel_bands_binned", "L7 H5 D24")(kernel_bands_binned)
