"""Grouped statistics, straight-line screening and group splits
(survey D1-D7, D23, C1, C2, G1-G3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: Sequence[str], value: str, out: str = "n") -> DataFrame:
    """D3: count per (keys..., value) - one aggregate, map-side combined."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(out))


def equal_response_groups(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    hi: int = 14,
    lo: int = 7,
    gap: int = 1,
    flag: str = "equal_response",
) -> DataFrame:
    """One row per group with a boolean straight-lining flag.

    A group is flagged when some value occurs ``>= hi`` times, or when among
    the counts in ``[lo, hi)`` sorted descending two neighbours differ by at
    most ``gap`` (formula F1). The window runs over the *aggregated* counts,
    i.e. at most one row per distinct value of a group.
    """
    return equal_response_from_counts(value_counts(df, keys, value, "__n"), keys, "__n", hi, lo, gap, flag)


def equal_response_from_counts(counts: DataFrame, keys: Sequence[str], n: str = "n", hi: int = 14, lo: int = 7,
                               gap: int = 1, flag: str = "equal_response") -> DataFrame:
    """D4 rule applied to a value-count table (one row per group and value)."""
    counts = counts.withColumnRenamed(n, "__n") if n != "__n" else counts
    mid = F.when((F.col("__n") >= lo) & (F.col("__n") < hi), F.col("__n"))
    w = Window.partitionBy(*keys).orderBy(F.col("__mid").desc_nulls_last())
    c = counts.withColumn("__mid", mid).withColumn("__prev", F.lag("__mid").over(w))
    near = F.col("__mid").isNotNull() & F.col("__prev").isNotNull() & (F.abs(F.col("__prev") - F.col("__mid")) <= gap)
    return c.groupBy(*keys).agg((F.max("__n") >= hi).__or__(F.bool_or(near)).alias(flag))


def split_equal_response(
    df: DataFrame, keys: Sequence[str], value: str, hi: int = 14, lo: int = 7, gap: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(rows of flagged groups, all other rows) via semi / anti join."""
    flagged = equal_response_groups(df, keys, value, hi, lo, gap).where("equal_response").drop("equal_response")
    return df.join(flagged, list(keys), "left_semi"), df.join(flagged, list(keys), "left_anti")


def tag_equal_response(df: DataFrame, keys: Sequence[str], value: str, hi: int = 14, lo: int = 7, gap: int = 1,
                       flag: str = "equal_response") -> DataFrame:
    """D4 as a row-level tag (G1 of both halves without a second scan)."""
    groups = equal_response_groups(df, keys, value, hi, lo, gap, flag)
    return df.join(groups, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def cell_summary(df: DataFrame, by: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Count, mean and sample sd per cell."""
    return df.groupBy(*by).agg(
        F.count(F.col(value)).alias(f"{prefix}n"),
        F.avg(value).alias(f"{prefix}mean"),
        F.stddev_samp(value).alias(f"{prefix}sd"),
    )


def distinct_count(df: DataFrame, col: str, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Exact (or HyperLogLog) distinct count."""
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return (df.groupBy(*by) if by else df.groupBy()).agg(agg.alias(f"n_distinct_{col}"))


def global_range(df: DataFrame, col: str) -> DataFrame:
    """Min, max, mean in one pass."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))


def label_distribution(df: DataFrame, label: str, classes: DataFrame | Sequence) -> DataFrame:
    """Count and share per class, absent classes as 0, inverse-frequency
    weight ``N / (k * count)`` (0 for absent classes)."""
    spark = df.sparkSession
    if not isinstance(classes, DataFrame):
        from panelkit.functions.common import literal_table

        classes = literal_table(spark, [(c,) for c in classes], [label])
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    j = F.broadcast(classes.select(label)).join(counts, label, "left").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0)).cast("bigint"))
    w = Window.partitionBy()  # over the class table only (k rows)
    total = F.sum("count").over(w)
    k = F.count(F.lit(1)).over(w)
    return j.select(
        label, "count",
        (F.col("count") / total).alias("share"),
        F.when(F.col("count") > 0, total / (k * F.col("count"))).otherwise(0.0).alias("weight"),
    )


def panel_description(df: DataFrame, group: str) -> DataFrame:
    """Rows, groups, min/max/mean group size - two-level aggregate."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(
        F.sum("__n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.min("__n").alias("min_group"),
        F.max("__n").alias("max_group"),
        F.avg("__n").alias("mean_group"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """G1: union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of ``cols``."""
    return df.select(*cols).distinct()


def name_difference(required: Sequence[str], present: Sequence[str]) -> list[str]:
    """G3 on column-name sets (driver-side, names only)."""
    return sorted(set(required) - set(present))
