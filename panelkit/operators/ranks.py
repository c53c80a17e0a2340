"""Exact ranks and row numbers without a single-task window (formula F3),
Holm adjustment (E3) and per-partition ranks (E2, E4).

A plain ``rank() over (order by v)`` moves the whole table into one task.
Here the order column is cut into buckets (quantile cut points, or fixed
edges for a uniform), every bucket is numbered by a window *partitioned by
bucket*, and a bucket offset (prefix sum over the few bucket totals) makes the
numbers global. Any cut points give the exact answer; good ones give balanced
tasks. Values are first counted per distinct value (map-side combined), so a
value holding a third of the rows is a single row from then on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _n_buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return buckets
    return max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Values kept to place the cut points of a column that is not numeric: a bottom-k sketch.
_SKETCH = 4096


def _is_numeric(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString().startswith(_NUMERIC)


def _order_key(df: DataFrame, col: str):
    """What the cut points are compared with: a double, or the value itself."""
    return F.col(col).cast("double") if _is_numeric(df, col) else F.col(col)


def _cut_points(df: DataFrame, col: str, n: int, uniform: bool) -> list:
    """Increasing cut points for about ``n`` equal buckets. Numeric columns
    take approximate quantiles; other columns the quantiles of a bottom-k
    sketch, the ``_SKETCH`` whole values with the least hash: a uniform sample
    of any ordered type that merges task by task, is the same on every retry and
    has one size whatever the number of buckets. Any cut points give exact
    numbers; they only set the balance."""
    if uniform:  # column known to be ~U[0,1): fixed edges, no pass over the data
        return [i / n for i in range(1, n)]
    if _is_numeric(df, col):
        probs = [i / n for i in range(1, n)]
        row = df.agg(F.percentile_approx(_order_key(df, col), probs, 1000).alias("q")).first()
        return sorted(set(float(x) for x in (row["q"] or []) if x is not None))
    least = (df.select(F.col(col).alias("__v")).where(F.col("__v").isNotNull())
             .orderBy(F.xxhash64("__v"), "__v").limit(_SKETCH).orderBy("__v").collect())
    return list(dict.fromkeys(least[len(least) * i // n]["__v"] for i in range(1, n) if least))


def _with_bucket(df: DataFrame, col: str, cuts: list, out: str = "__b") -> DataFrame:
    """Add the number of cut points strictly below the order key: a binary
    search over one literal array, one projection per halving, so plan and
    generated code grow with log2 of the bucket count."""
    df = df.withColumn(out, F.lit(0))
    if not cuts:
        return df
    key, table = _order_key(df, col), F.lit(cuts)
    step = 1 << (len(cuts).bit_length() - 1)
    while step:
        above = F.get(table, F.col(out) + F.lit(step - 1)) < key  # null past the end
        df = df.withColumn(out, F.col(out) + F.when(above, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    return df


def _offsets(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket: running sum over the bucket totals table
    (at most groups x buckets rows)."""
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__off", F.coalesce(F.sum("__tot").over(w), F.lit(0)))


def average_rank(df: DataFrame, col: str, out: str = "rank", by: Sequence[str] = (),
                 buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Average rank of ``col`` (ties share the mean of their positions),
    over the whole table or within ``by`` groups. Nulls get a null rank.
    ``weight``: the number of rows that a row stands for."""
    by = list(by)
    n_b = _n_buckets(df, buckets)
    vals = df.where(F.col(col).isNotNull())
    counts = vals.groupBy(*by, col).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    # strings: distinct values, so that a frequent one does not fill the sketch
    cuts = _cut_points(vals if _is_numeric(vals, col) else counts, col, n_b, uniform=False)
    counts = _with_bucket(counts, col, cuts)
    totals = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__tot"))
    offs = _offsets(totals, by).drop("__tot")
    w = Window.partitionBy(*by, "__b").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.withColumn("__cum", F.sum("__n").over(w))
              .join(offs, by + ["__b"], "inner")
              .select(*by, col, (F.col("__off") + F.col("__cum") - F.col("__n")
                                 + (F.col("__n") + 1) / 2.0).alias(out)))
    return df.join(ranked, by + [col], "left")


def row_number(df: DataFrame, order: Sequence[str], out: str = "row_number", by: Sequence[str] = (),
               buckets: int | None = None, uniform_first: bool | None = None) -> DataFrame:
    """Exact 1-based row number in ``order`` (ties broken by the later order
    columns; give a unique last column), globally or within ``by``.

    The first order column is bucketed; ``uniform_first`` (auto for columns
    named ``__u``) uses fixed edges instead of a quantile pass.
    """
    by = list(by)
    first = order[0]
    n_b = _n_buckets(df, buckets)
    uni = uniform_first if uniform_first is not None else first == "__u"
    cuts = _cut_points(df, first, n_b, uniform=uni)
    b = _with_bucket(df, first, cuts)
    totals = b.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__tot"))
    offs = _offsets(totals, by).drop("__tot")
    w = Window.partitionBy(*by, "__b").orderBy(*order)
    return (b.withColumn("__rn_in", F.row_number().over(w))
            .join(F.broadcast(offs) if not by else offs, by + ["__b"], "inner")
            .withColumn(out, F.col("__off") + F.col("__rn_in"))
            .drop("__b", "__rn_in", "__off"))


def holm(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "p_holm", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Holm step-down adjustment within ``by``:
    running max of ``(m - r + 1) * p_(r)``, capped at 1. Runs on result
    tables (one row per test)."""
    w_all = Window.partitionBy(*by)
    w = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *tiebreak)
    d = (df.withColumn("__m", F.count(F.col(p)).over(w_all))
         .withColumn("__r", F.row_number().over(w)))
    step = (F.col("__m") - F.col("__r") + 1) * F.col(p)
    run = F.max(step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col(p).isNull(), None).otherwise(F.least(F.lit(1.0), run))).drop("__m", "__r")


def rank_within(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", descending: bool = True,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rank within a partition, ties get the minimum rank."""
    o = F.col(value).desc() if descending else F.col(value).asc()
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(o)))


def exact_percentile(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                     buckets: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation (``quantile_cont``
    semantics) without gathering a group's values in one task.

    Values are counted per (group, value) - map-side combined, so a value
    held by a third of the rows is one row - and positioned by the bucketed
    prefix sums of :func:`average_rank`; the k-th smallest value is found by
    interval lookup. Returns one row per (group, p): ``p``, ``value``.
    """
    by = list(by)
    n_b = _n_buckets(df, buckets)
    vals = df.select(*by, F.col(col).alias("__v")).where(F.col("__v").isNotNull())
    counts = vals.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    cuts = _cut_points(vals if _is_numeric(vals, "__v") else counts, "__v", n_b, uniform=False)
    counts = _with_bucket(counts, "__v", cuts)
    totals = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__tot"))
    offs = _offsets(totals, by).drop("__tot")
    w = Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    pos = (counts.withColumn("__cum", F.sum("__n").over(w)).join(offs, by + ["__b"], "inner")
           .select(*by, "__v", (F.col("__off") + F.col("__cum") - F.col("__n") + 1).alias("__start"),
                   (F.col("__off") + F.col("__cum")).alias("__end")))
    gsize = counts.groupBy(*by).agg(F.sum("__n").alias("__N")) if by else counts.agg(F.sum("__n").alias("__N"))
    from panelkit.functions.common import literal_table

    ps = literal_table(df.sparkSession, [(float(p),) for p in probs], ["p"], ["double"])
    targets = gsize.crossJoin(F.broadcast(ps)).withColumn("__pos", F.lit(1.0) + F.col("p") * (F.col("__N") - 1))
    targets = targets.select(*by, "p", F.floor("__pos").alias("__klo"), F.ceil("__pos").alias("__khi"),
                             (F.col("__pos") - F.floor("__pos")).alias("__frac"))
    j = pos.join(targets, by, "inner") if by else pos.crossJoin(targets)
    lo_hit = (F.col("__start") <= F.col("__klo")) & (F.col("__klo") <= F.col("__end"))
    hi_hit = (F.col("__start") <= F.col("__khi")) & (F.col("__khi") <= F.col("__end"))
    agg = j.where(lo_hit | hi_hit).groupBy(*by, "p", "__frac").agg(
        F.max(F.when(lo_hit, F.col("__v"))).alias("__lo"), F.max(F.when(hi_hit, F.col("__v"))).alias("__hi"))
    return agg.select(*by, "p", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias("value"))
