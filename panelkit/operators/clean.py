"""Cleaning, recoding and row filters (survey 2.B, B5, B13-B15, C10, E1)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.common import as_col, literal_map
from panelkit.session import materialize


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """B1 (subset) / B2 (any column). Null and NaN are both dropped."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def missing_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """B1 report: rows, rows kept, rows dropped - one aggregate pass."""
    cols = list(subset) if subset else df.columns
    bad = F.lit(False)
    for c in cols:
        dt = df.schema[c].dataType.simpleString()
        test = F.col(c).isNull()
        if dt in ("double", "float"):
            test = test | F.isnan(F.col(c))
        bad = bad | test
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~bad).alias("n_kept"),
        F.count_if(bad).alias("n_dropped"),
    )


def recode(
    df: DataFrame,
    col: str,
    mapping: Mapping,
    unmapped: str = "keep",
    lower: bool = False,
    trim: bool = False,
    out: str | None = None,
) -> DataFrame:
    """Recode a column by a literal map.

    ``unmapped='keep'`` (B8: values without an entry stay), ``'null'`` (B9),
    ``'raise'`` (fail the job on an unknown value). ``lower``/``trim`` are
    applied to the lookup key first (B9, B10).
    """
    key = F.col(col).cast("string") if lower or trim else F.col(col)
    if trim:
        key = F.trim(key)
    if lower:
        key = F.lower(key)
    looked = F.try_element_at(literal_map(mapping), key) if mapping else F.lit(None)
    if unmapped == "keep":
        expr = F.coalesce(looked, F.col(col))
    elif unmapped == "null":
        expr = looked
    elif unmapped == "raise":
        expr = F.when(F.col(col).isNull(), F.lit(None)).when(looked.isNotNull(), looked).otherwise(
            F.raise_error(F.concat(F.lit(f"unknown value for {col}: "), F.col(col).cast("string"))))
    else:
        raise ValueError(f"unmapped must be keep/null/raise, got {unmapped!r}")
    return df.withColumn(out or col, expr)


def to_number(df: DataFrame, cols: Iterable[str], strict: bool = True, dtype: str = "double") -> DataFrame:
    """Numeric cast. ``strict`` raises on bad input (ANSI cast), else null."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast(dtype) if strict else F.expr(f"try_cast(`{c}` AS {dtype})"))
    return df


def to_string(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Cast listed columns to string, others untouched."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


def composite_key(df: DataFrame, cols: Sequence[str], out: str, sep: str = "_") -> DataFrame:
    """Key by concatenation."""
    return df.withColumn(out, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))


def center(df: DataFrame, col: str, out: str | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """Subtract the (grand or per-``by``) mean.

    The grand mean is a one-row aggregate joined back with a broadcast (size 1).
    """
    return _standardize(df, col, out or f"{col}_c", by, scale=False)


def zscore(df: DataFrame, col: str, out: str | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / sample sd; null where the sd is 0 or undefined."""
    return _standardize(df, col, out or f"{col}_z", by, scale=True)


def _standardize(df, col, out, by, scale):
    aggs = [F.avg(col).alias("__mu")]
    if scale:
        aggs.append(F.stddev_samp(col).alias("__sd"))
    if by:
        stats = df.groupBy(*by).agg(*aggs)
        j = df.join(stats, list(by), "left")
    else:
        j = df.crossJoin(F.broadcast(df.agg(*aggs)))
    expr = F.col(col) - F.col("__mu")
    if scale:
        expr = F.try_divide(expr, F.col("__sd"))
    return j.withColumn(out, expr).drop("__mu", "__sd")


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B15 fit: one-row table of mean and population sd per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__sd")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B15 apply: (x - mean)/sd with sd 0 treated as 1 (scaler convention)."""
    j = df.crossJoin(F.broadcast(stats))
    for c in cols:
        sd = F.col(f"{c}__sd")
        j = j.withColumn(c, (F.col(c) - F.col(f"{c}__mean")) / F.when(sd == 0, 1.0).otherwise(sd))
    return j.drop(*[f"{c}__mean" for c in cols], *[f"{c}__sd" for c in cols])


def exclude_ids(df: DataFrame, id_col: str, ids: DataFrame | Sequence, ids_col: str | None = None) -> DataFrame:
    """Drop rows whose id is listed; rows with a null id are kept (R ``%!in%``).

    ``ids`` may be a literal list (bounded by construction) or a DataFrame
    (left-anti join; Spark/AQE picks broadcast only when its size allows).
    """
    if not isinstance(ids, DataFrame):
        return df.where(F.col(id_col).isNull() | ~F.col(id_col).isin(list(ids)))
    ids_col = ids_col or id_col
    right = ids.select(F.col(ids_col).alias("__xid")).where(F.col("__xid").isNotNull()).distinct()
    return df.join(right, F.col(id_col) == F.col("__xid"), "left_anti")


def min_group_size(df: DataFrame, by: Sequence[str], k: int, count_col: str | None = None) -> DataFrame:
    """Keep rows of groups with at least ``k`` rows.

    Counted with a (map-side combined) grouped aggregate and a semi-join back,
    so a hot group never has to sit sorted in one window task.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k)
    if count_col:
        return df.join(sizes.withColumnRenamed("__n", count_col), list(by), "inner")
    return df.join(sizes.drop("__n"), list(by), "left_semi")


def tag_repeat_ids(df: DataFrame, id_col: str, combo_cols: Sequence[str], order_col: str,
                   suffix: str = "_a", out: str | None = None) -> DataFrame:
    """An id gets ``suffix`` unless the row's combination equals the id's
    *last* combination in ``order_col`` order.

    Last combination per id by ``max_by`` in a grouped aggregate, joined back
    on the id (no whole-group window).
    """
    combo = F.concat_ws(" ", *[F.col(c).cast("string") for c in combo_cols])
    base = df.withColumn("__combo", combo)
    last = base.groupBy(id_col).agg(F.max_by("__combo", F.col(order_col)).alias("__last"))
    j = base.join(last, id_col, "left")
    tagged = F.when(F.col("__combo") == F.col("__last"), F.col(id_col).cast("string")).otherwise(
        F.concat(F.col(id_col).cast("string"), F.lit(suffix)))
    return j.withColumn(out or id_col, tagged).drop("__combo", "__last")


#: Groups up to which a table of one row per group is sent to every task.
BROADCAST_GROUPS = 100_000


def _with_stats(df: DataFrame, stats: DataFrame, group: str) -> DataFrame:
    """Left join of one row per group. Few groups (counted first) are broadcast:
    a shuffle by group would sort a whole group in one task."""
    stats = materialize(stats)
    return df.join(F.broadcast(stats) if stats.count() <= BROADCAST_GROUPS else stats, group, "left")


def remove_group_outliers(df: DataFrame, group: str, value: str, z: float = 3.0, id_cols: Sequence[str] = ()) -> DataFrame:
    """Drop rows whose robust z-score (median/MAD within ``group``) exceeds ``z``.
    A group with MAD 0 has no robust z-score and keeps all its rows.

    Medians by the distributed exact percentile; removal as a left-anti
    join on the row identity (``id_cols``) when given, else a filter.
    """
    from panelkit.operators.ranks import exact_percentile

    med = exact_percentile(df, value, [0.5], by=[group]).select(group, F.col("value").alias("__med"))
    j = _with_stats(df, med, group).withColumn("__dev", F.abs(F.col(value) - F.col("__med")))
    mad = exact_percentile(j, "__dev", [0.5], by=[group]).select(group, F.col("value").alias("__mad"))
    j = _with_stats(j, mad, group)
    rz = F.try_divide(F.col("__dev"), F.lit(1.4826) * F.col("__mad"))
    out = F.coalesce(rz > z, F.lit(False))
    if id_cols:
        bad = j.where(out).select(*id_cols)
        return df.join(bad, list(id_cols), "left_anti")
    return j.where(~out).drop("__med", "__dev", "__mad")


def where_all(df: DataFrame, **equals) -> DataFrame:
    """Conjunction of equality predicates."""
    cond: Column = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == as_col(v))
    return df.where(cond)
