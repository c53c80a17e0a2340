"""Regression and classification metrics (survey D8-D16, F8-F11).

Every metric is one or two grouped aggregates over the scored table; only
class-sized tables (k rows, k x k cells) are ever joined or windowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, R2 (``R2 = 1 - SSE / (n * var_pop(y))``); for a
    constant ``y`` R2 is 1 when every error is 0, else 0."""
    err = F.col(y) - F.col(pred)
    g = df.groupBy(*by) if by else df.groupBy()
    a = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
              F.var_pop(y).alias("__vy"))
    return a.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("__vy") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
                    .otherwise(F.lit(1.0) - F.try_divide("mse", "__vy")).alias("r2"))


def quantile_mae(long_df: DataFrame, y: str, pred: str = "prediction", q: str = "quantile") -> DataFrame:
    """MAE per predicted quantile (input from ``encode.unpivot_quantiles``)."""
    return long_df.groupBy(q).agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"))


def mode_mae(df: DataFrame, y: str, mode: str) -> DataFrame:
    """MAE of the mode prediction (one row, ``quantile`` null)."""
    return df.agg(F.lit(None).cast("double").alias("quantile"), F.avg(F.abs(F.col(y) - F.col(mode))).alias("mae"))


def argmax_class(probs: str):
    """Arg-max class index (0-based, lowest index on ties)."""
    return (F.array_position(F.col(probs), F.array_max(F.col(probs))) - 1).cast("int")


def _class_table(df: DataFrame, classes: Sequence[int] | int, name: str = "cls") -> DataFrame:
    from panelkit.functions.common import literal_table

    k = list(range(classes)) if isinstance(classes, int) else list(classes)
    return literal_table(df.sparkSession, [(int(c),) for c in k], [name], ["int"])


def class_counts(df: DataFrame, y: str, pred: str, classes: Sequence[int] | int) -> DataFrame:
    """F9 building block: tp, fp, fn, support per class, absent classes kept.

    One aggregate pass with conditional counts per class (k known on the
    driver), then a k-row unpivot: no join, no second shuffle.
    """
    k = list(range(classes)) if isinstance(classes, int) else list(classes)
    t, p = F.col(y), F.col(pred)
    aggs = []
    for c in k:
        aggs += [F.count_if((t == c) & (p == c)).alias(f"tp{c}"), F.count_if((t != c) & (p == c)).alias(f"fp{c}"),
                 F.count_if((t == c) & (p != c)).alias(f"fn{c}"), F.count_if(t == c).alias(f"s{c}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(int(c)).alias("cls"), F.col(f"tp{c}").alias("tp"), F.col(f"fp{c}").alias("fp"),
                              F.col(f"fn{c}").alias("fn"), F.col(f"s{c}").alias("support")) for c in k])
    return wide.select(F.inline(rows))


def per_class_report(df: DataFrame, y: str, pred: str, classes: Sequence[int] | int) -> DataFrame:
    """Precision, recall, F1, support per class; 0 on zero division."""
    c = class_counts(df, y, pred, classes)
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    return c.select("cls", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                    "support")


def macro_scores(df: DataFrame, y: str, pred: str, classes: Sequence[int] | int) -> DataFrame:
    """Plain accuracy, macro accuracy (mean per-class recall) and
    macro F1 over classes with ``tp + fp + fn > 0``."""
    c = class_counts(df, y, pred, classes)
    present = (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return c.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, recall)).alias("macro_accuracy"),
        F.avg(F.when(present, f1)).alias("macro_f1"),
    )


def confusion(df: DataFrame, y: str, pred: str, classes: Sequence[int] | int, normalize: str | None = "pred") -> DataFrame:
    """Long confusion table (true, pred, count, share); ``normalize='pred'``
    divides by the predicted-class total, ``'true'`` by the true-class total.

    The k x k grid is joined with null-safe keys: a null-rejecting join would
    make Catalyst push an ``isnotnull`` copy of the (possibly large) label
    expressions into the scan, outside whole-stage codegen.
    """
    cells = df.groupBy(F.col(y).alias("__t"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    ct = _class_table(df, classes, "y_true").crossJoin(_class_table(df, classes, "y_pred"))
    cond = F.col("y_true").eqNullSafe(F.col("__t")) & F.col("y_pred").eqNullSafe(F.col("__p"))
    full = ct.join(F.broadcast(cells), cond, "left").select(
        "y_true", "y_pred", F.coalesce(F.col("__n"), F.lit(0)).cast("bigint").alias("count"))
    if normalize is None:
        return full
    by = "y_pred" if normalize == "pred" else "y_true"
    tot = F.sum("count").over(Window.partitionBy(by))  # k x k table only
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("count"), tot), F.lit(0.0)).cast("double"))


def quadratic_kappa(df: DataFrame, y: str, pred: str, classes: Sequence[int] | int) -> DataFrame:
    """``1 - sum(w O) / sum(w E)``, ``w = (i-j)^2``, ``E = row_i col_j / N``."""
    cells = confusion(df, y, pred, classes, normalize=None)
    rows = cells.groupBy("y_true").agg(F.sum("count").alias("__r"))
    cols = cells.groupBy("y_pred").agg(F.sum("count").alias("__c"))
    n = cells.agg(F.sum("count").alias("__N"))
    w = (F.col("y_true") - F.col("y_pred")) ** 2
    j = cells.join(rows, "y_true").join(cols, "y_pred").crossJoin(n)
    return j.agg((F.lit(1.0) - F.sum(w * F.col("count")) / F.sum(w * F.col("__r") * F.col("__c") / F.col("__N")))
                 .alias("qwk"))


def class_value_mae(df: DataFrame, y_value: str, pred_index: str, class_values: Sequence[float]) -> DataFrame:
    """MAE in original units of the predicted class (B26 lookup)."""
    vals = F.array(*[F.lit(float(v)) for v in class_values])
    return df.agg(F.avg(F.abs(F.element_at(vals, F.col(pred_index) + 1) - F.col(y_value))).alias("mae_value"))


def calibration_bins(df: DataFrame, y: str, probs: str, n_bins: int = 10) -> DataFrame:
    """Equal-width bins on max probability (left-closed, 1.0 in the
    last bin): count, accuracy, mean confidence per non-empty bin."""
    conf = F.array_max(F.col(probs))
    b = F.least(F.lit(n_bins - 1), F.floor(conf * n_bins)).cast("int")
    correct = (argmax_class(probs) == F.col(y)).cast("double")
    return (df.select(b.alias("bin"), conf.alias("__conf"), correct.alias("__ok"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("__ok").alias("accuracy"),
                                F.avg("__conf").alias("confidence")))


def ece(df: DataFrame, y: str, probs: str, n_bins: int = 10) -> DataFrame:
    """Expected calibration error ``sum n_b/N |acc_b - conf_b|``."""
    bins = calibration_bins(df, y, probs, n_bins)
    return bins.agg((F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("count"))
                    .alias("ece"))


def cross_entropy(df: DataFrame, y: str, probs: str, eps: float = 0.0) -> DataFrame:
    """Mean ``-ln p[y]``."""
    p = F.element_at(F.col(probs), F.col(y) + 1)
    if eps:
        p = F.greatest(p, F.lit(eps))
    return df.agg((-F.avg(F.ln(p))).alias("cross_entropy"))


def best_so_far(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Running minimum of ``value`` in ``order`` (an epoch-sized table per
    run), and whether the row improves on everything before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.min(value).over(w)
    return df.select(*by, order, value, F.least(F.col(value), before).alias("best"),
                     (before.isNull() | (F.col(value) < before)).alias("improved"))
