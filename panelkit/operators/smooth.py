"""Kernel-smoothed curves with bootstrap bands (survey L7, F14, H5, D24).

The curve at grid point g is ``sum w*y / sum w`` with a Gaussian kernel
``w = exp(-0.5 ((g - x)/h)^2)``. It only needs ``(n, sum y)`` per distinct x,
so rows are pre-aggregated by (cell, x) before the (bounded) grid cross join;
each bootstrap replicate is the same aggregate with Poisson(1) row weights,
so replicates are rows of one job, not a loop.

For continuous x, ``bins`` replaces the distinct values by a regular grid of
that many steps: linear binning shares every row between the two grid points
around it, so the curve is a sum over bins, whatever the number of rows. A
Gaussian kernel of width h then errs by at most ``(step / h)^2 / 8`` of its
height; ``TAIL`` widths from a grid point it is cut off (less than 2e-8).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _grid(df: DataFrame, x: str, points: int, bandwidth: float | None):
    rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    h = F.lit(float(bandwidth)) if bandwidth else F.greatest((F.col("__hi") - F.col("__lo")) / 8.0, F.lit(0.5))
    steps = df.sparkSession.range(points).withColumnRenamed("id", "grid_index")
    return steps.crossJoin(F.broadcast(rng)).select(
        "grid_index", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("grid_index") / (points - 1)).alias("g"),
        h.alias("__h"))


#: Kernel widths beyond which a bin adds nothing to a grid point.
TAIL = 6.0


def _limits(base: DataFrame, *cols: str) -> DataFrame:
    return F.broadcast(base.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]))  # one row


def _position(c: str, bins: int):
    """Place of a value on the bin grid, in steps; 0 without any spread."""
    width = F.col(f"{c}_hi") - F.col(f"{c}_lo")
    return F.when(width > 0, (F.col(c) - F.col(f"{c}_lo")) / width * bins).otherwise(0.0)


def _value(c: str, place, bins: int):
    return F.col(f"{c}_lo") + (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * place / bins


def linear_bins(base: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """(keys..., __x, __n, __sy) on ``bins + 1`` grid points: a row between two
    of them counts for each in proportion to its nearness. ``base``: keys, __x,
    __yv; one aggregate, combined map-side."""
    b = base.crossJoin(_limits(base, "__x")).withColumn("__p", _position("__x", bins)).withColumn("__i", F.floor("__p"))
    part = F.col("__p") - F.col("__i")
    ends = F.inline(F.array(F.struct(F.col("__i").alias("__k"), (1 - part).alias("__s")), F.struct((F.col("__i") + 1).alias("__k"), part.alias("__s"))))
    rows = b.select(*by, "__yv", "__x_lo", "__x_hi", ends).where("__s > 0")
    sums = rows.groupBy(*by, "__k", "__x_lo", "__x_hi").agg(F.sum("__s").alias("__n"), F.sum(F.col("__s") * F.col("__yv")).alias("__sy"))
    return sums.select(*by, _value("__x", F.col("__k"), bins).alias("__x"), "__n", "__sy")


def _curve(stats: DataFrame, grid: DataFrame, keys: Sequence[str], tail: float | None = None) -> DataFrame:
    """stats: (keys..., __x, __n, __sy) -> (keys..., grid_index, g, curve)."""
    z = (F.col("g") - F.col("__x")) / F.col("__h")
    w = F.exp(-0.5 * z ** 2)
    j = stats.crossJoin(F.broadcast(grid))  # grid has `points` rows
    if tail is not None:
        w = F.when(F.abs(z) <= tail, w).otherwise(0.0)
    c = j.groupBy(*keys, "grid_index", "g").agg(F.sum(w * F.col("__sy")).alias("__num"),
                                               F.sum(w * F.col("__n")).alias("__den"))
    return c.select(*keys, "grid_index", "g",
                    (F.col("__num") / F.when(F.col("__den") == 0, 1.0).otherwise(F.col("__den"))).alias("curve"))


def kernel_curve(df: DataFrame, x: str, y: str, by: Sequence[str], points: int = 80, bandwidth: float | None = None,
                 min_points: int = 5, bins: int | None = None) -> DataFrame:
    """L7/F14 point estimate per cell on a shared grid (global min..max of x,
    bandwidth ``max(range/8, 0.5)``); cells with fewer than ``min_points``
    rows get a flat line at their mean. ``bins`` (continuous x): linear binning
    instead of the distinct values of x."""
    by = list(by)
    base = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__yv")).where(
        F.col("__x").isNotNull() & F.col("__yv").isNotNull())
    grid = _grid(base.withColumnRenamed("__x", x), x, points, bandwidth)
    stats = linear_bins(base, by, bins) if bins else \
        base.groupBy(*by, "__x").agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum("__yv").alias("__sy"))
    cells = base.groupBy(*by).agg(F.count(F.lit(1)).alias("__cn"), F.avg("__yv").alias("__cm"))
    curve = _curve(stats, grid, by, TAIL if bins else None).join(cells, by)
    return curve.select(*by, "grid_index", "g", F.when(F.col("__cn") < min_points, F.col("__cm"))
                        .otherwise(F.col("curve")).alias("curve"))


def kernel_curve_band(df: DataFrame, x: str, y: str, by: Sequence[str], key: str | None = None,
                      replicates: int = 200, points: int = 80, bandwidth: float | None = None, min_points: int = 5,
                      seed: int = 42, level: float = 0.95, bins: int | None = None) -> DataFrame:
    """L7 with a pointwise percentile band over Poisson-bootstrap replicates.

    The curve needs only (weight, weighted y) per (cell, x), so rows are
    counted per (cell, x, y) once and every replicate draws one Poisson(n)
    weight per count (exactly the row-level Poisson bootstrap in
    distribution): cost is distinct values x replicates, not rows x
    replicates. ``bins`` (continuous data): x and y are moved to the nearest of
    ``bins + 1`` grid values for the replicates, so cost is at most bins^2 per
    cell and replicate; a replicate's curve then moves by at most half a step
    of y and ``(step / h) / 2`` of the kernel's height. ``key`` is accepted for
    API symmetry and unused.
    """
    from panelkit.operators.split import poisson_replicate_counts

    by = list(by)
    base = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__yv")).where(
        F.col("__x").isNotNull() & F.col("__yv").isNotNull())
    grid = _grid(base.withColumnRenamed("__x", x), x, points, bandwidth)
    drawn = base
    if bins:
        near = [_value(c, F.round(_position(c, bins)), bins).alias(c) for c in ("__x", "__yv")]
        drawn = base.crossJoin(_limits(base, "__x", "__yv")).select(*by, *near)
    counts = drawn.groupBy(*by, "__x", "__yv").agg(F.count(F.lit(1)).alias("__c"))
    draws = poisson_replicate_counts(counts, "__c", by + ["__x", "__yv"], replicates, seed, "__b", "__w")
    stats = draws.groupBy(*by, "__b", "__x").agg(F.sum("__w").alias("__n"),
                                                F.sum(F.col("__w") * F.col("__yv")).alias("__sy"))
    curves = _curve(stats, grid, by + ["__b"], TAIL if bins else None)
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    band = curves.groupBy(*by, "grid_index").agg(F.percentile("curve", lo).alias("lower"),
                                                 F.percentile("curve", hi).alias("upper"))
    point = kernel_curve(df, x, y, by, points, bandwidth, min_points, bins)
    cells = base.groupBy(*by).agg(F.count(F.lit(1)).alias("__cn"))
    out = point.join(band, by + ["grid_index"], "left").join(cells, by)
    flat = F.col("__cn") < min_points
    return out.select(*by, "grid_index", "g", "curve", F.when(flat, F.col("curve")).otherwise(F.col("lower")).alias("lower"),
                      F.when(flat, F.col("curve")).otherwise(F.col("upper")).alias("upper"))
