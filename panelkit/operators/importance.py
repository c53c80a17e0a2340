"""Importance tables: normalisation, one-hot consolidation, spread over
trees, rank stability (survey D17-D19, D22, D26, E2, L11, L12).

Inputs are tidy ``(feature, model, importance)`` tables or flat node tables
``(tree, feature, gain)``; everything is grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.encode import parent_feature


def normalize(df: DataFrame, model: str = "model", value: str = "importance", out: str | None = None) -> DataFrame:
    """Negatives to 0, divide by the model's total; a zero total keeps zeros."""
    pos = F.greatest(F.col(value), F.lit(0.0))
    tot = df.groupBy(model).agg(F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("__tot"))
    return (df.join(tot, model).withColumn(out or value, F.when(F.col("__tot") > 0, pos / F.col("__tot"))
                                           .otherwise(pos)).drop("__tot"))


def consolidate(df: DataFrame, parents: Sequence[str], feature: str = "feature", model: str = "model",
                value: str = "importance", strip_prefix: str | None = "__") -> DataFrame:
    """D18 (+B27): map one-hot names to their parent feature and sum."""
    mapped = df.withColumn(feature, parent_feature(feature, parents, strip_prefix or ""))
    return mapped.groupBy(feature, model).agg(F.sum(value).alias(value))


def spread_over_trees(nodes: DataFrame, tree: str = "tree", feature: str = "feature", gain: str = "gain",
                      sd: str = "pop", over: str = "trees_with_splits", n_trees: int | None = None) -> DataFrame:
    """Sd over trees of the per-tree gain sum of each feature, with
    trees where the feature does not split counting as 0.

    ``sd='samp'`` + ``over='trees_with_splits'`` is the boosted-tree-dump rule,
    ``sd='pop'`` + ``n_trees`` (all trees) the other two. Computed from
    ``sum`` and ``sum of squares`` of per-tree sums, so the zero cells are
    never materialised.
    """
    per = nodes.groupBy(tree, feature).agg(F.sum(gain).alias("__g"))
    agg = per.groupBy(feature).agg(F.sum("__g").alias("total_gain"), F.sum(F.col("__g") * F.col("__g")).alias("__s2"))
    if n_trees is not None:
        t = nodes.sparkSession.range(1).select(F.lit(int(n_trees)).cast("long").alias("__T"))
    else:
        t = nodes.agg(F.count_distinct(tree).alias("__T"))
    j = agg.crossJoin(F.broadcast(t))
    m = F.col("total_gain") / F.col("__T")
    ss = F.col("__s2") - F.col("__T") * m * m
    denom = F.col("__T") - 1 if sd == "samp" else F.col("__T")
    return j.select(feature, "total_gain", F.sqrt(F.try_divide(F.greatest(ss, F.lit(0.0)), denom)).alias(f"sd_{sd}"))


def pivot_models(df: DataFrame, models: Sequence[str] | None = None, feature: str = "feature", model: str = "model",
                 value: str = "importance") -> DataFrame:
    """Feature x model, missing cells 0."""
    return df.groupBy(feature).pivot(model, list(models) if models else None).agg(F.sum(value)).na.fill(0.0)


def rank_table(df: DataFrame, feature: str = "feature", model: str = "model", value: str = "importance") -> DataFrame:
    """L11 (E2, D26): per model rank (descending, ties minimum) after filling
    absent (feature, model) cells with 0, plus each feature's mean importance
    across models for ordering."""
    feats = df.select(feature).distinct()
    mods = df.select(model).distinct()
    full = feats.crossJoin(mods).join(df.select(feature, model, value), [feature, model], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0.0)))  # features x models: a result-size table
    ranked = full.withColumn("rank", F.rank().over(Window.partitionBy(model).orderBy(F.col(value).desc())))
    means = full.groupBy(feature).agg(F.avg(value).alias("mean_importance"))
    return ranked.join(means, feature)
