"""Encoders and design columns (survey B10, B16-B35).

Fitted encoders collect only the *level list* of a column (bounded by
``max_levels``, checked) to the driver - the same contract as an MLlib
``StringIndexer`` fit - and apply as plain Column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.common import literal_map

# Fixed vocabularies of the reference's fixed-width encoder (values that must
# match for equal results).
SCENARIO_LEVELS = ["3Spurig", "Spielstrasse", "Ueberland", "NeueMitte"]
CODE_LEVELS = ["A1", "A2", "A3", "A4", "A5", "A6"]
FIXED_WIDTHS = {"gender": 4, "education": 5, "job": 6, "driving_frequency": 6, "distance": 5}
INTRO_SPELLINGS = {"ambiguous": 0.0, "ambigious": 0.0, "boasting": 1.0}
LABEL_MODES = ("floor", "separate_fractional")


# ----------------------------------------------------------------- fitted levels
def fit_levels(df: DataFrame, cols: Sequence[str], max_levels: int = 10_000) -> dict[str, list]:
    """Sorted distinct non-null levels per column (distributed distinct, then
    at most ``max_levels + 1`` rows per column reach the driver)."""
    out = {}
    for c in cols:
        rows = (df.select(F.col(c)).where(F.col(c).isNotNull()).distinct().orderBy(c)
                .limit(max_levels + 1).collect())
        if len(rows) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        out[c] = [r[0] for r in rows]
    return out


def level_table(spark, levels: Mapping[str, Sequence]) -> DataFrame:
    """Level table (feature, level, ord) from fitted levels."""
    rows = [(f, str(lv), i) for f, lvs in levels.items() for i, lv in enumerate(lvs)]
    return spark.createDataFrame(rows, "feature string, level string, ord int")


def one_hot(df: DataFrame, levels: Mapping[str, Sequence], drop: str | None = "first", sep: str = "_",
            unknown: str = "zero", keep_input: bool = False) -> DataFrame:
    """B22 (``drop='first'``) / B23 (``drop=None``): one double column per
    level; unknown levels give all zeros (``unknown='zero'``) or fail the job
    (``'raise'``)."""
    cols = []
    for c, lvs in levels.items():
        use = list(lvs)[1:] if drop == "first" else list(lvs)
        for lv in use:
            cols.append((F.col(c) == F.lit(lv)).cast("double").alias(f"{c}{sep}{lv}"))
        if unknown == "raise":
            known = F.col(c).isin(list(lvs))
            cols.append(F.when(known | F.col(c).isNull(), F.lit(None)).otherwise(
                F.raise_error(F.concat(F.lit(f"unknown level for {c}: "), F.col(c).cast("string")))).alias(f"__chk_{c}"))
    out = df.select("*", *cols)
    out = out.drop(*[f"__chk_{c}" for c in levels]) if unknown == "raise" else out
    return out if keep_input else out.drop(*levels.keys())


def codes(df: DataFrame, levels: Mapping[str, Sequence], unseen: int = -1, suffix: str = "") -> DataFrame:
    """code = position in sorted level list; unseen level -> ``unseen``."""
    for c, lvs in levels.items():
        m = literal_map({lv: i for i, lv in enumerate(lvs)})
        df = df.withColumn(c + suffix, F.coalesce(F.try_element_at(m, F.col(c)), F.lit(unseen)).cast("int"))
    return df


def codes_by_join(df: DataFrame, col: str, fit_on: DataFrame, out: str | None = None, unseen: int = -1) -> DataFrame:
    """B24 for high-cardinality columns: the level table (distinct values of
    ``fit_on`` numbered in sort order by the distributed row number) is
    left-joined; unseen levels get ``unseen``. Nothing reaches the driver."""
    from panelkit.operators.ranks import row_number

    lv = fit_on.select(F.col(col).alias("__lv")).where(F.col("__lv").isNotNull()).distinct()
    table = row_number(lv, ["__lv"], out="__code").select("__lv", (F.col("__code") - 1).cast("int").alias("__code"))
    j = df.join(table, df[col] == table["__lv"], "left")
    return j.withColumn(out or col, F.coalesce(F.col("__code"), F.lit(unseen))).drop("__lv", "__code")


def fixed_one_hot(col: str | Column, levels: Sequence[str], name: str = "value") -> Column:
    """ARRAY<DOUBLE> one-hot over a fixed vocabulary of the trimmed
    string; an unknown value fails the job."""
    c = F.trim(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))
    known = c.isin(list(levels))
    arr = F.array(*[(c == F.lit(lv)).cast("double") for lv in levels])
    return F.when(known, arr).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown value for {name}: "), F.coalesce(c, F.lit("NULL")))))


def fixed_code_one_hot(col: str, width: int, name: str | None = None) -> Column:
    """B20 for the A1..Ak code columns."""
    return fixed_one_hot(col, CODE_LEVELS[:width], name or col)


def intro_binary(col: str) -> Column:
    """Trimmed, lower-cased two-value encoder (both spellings of the
    first value), unknown fails."""
    key = F.lower(F.trim(F.col(col).cast("string")))
    return F.coalesce(F.try_element_at(literal_map(INTRO_SPELLINGS), key),
                      F.raise_error(F.concat(F.lit(f"unknown value for {col}: "), F.coalesce(key, F.lit("NULL")))))


def yes_flag(col: str, yes: str = "Y") -> Column:
    """1.0 when the value equals ``yes`` else 0.0 (null -> 0)."""
    return F.coalesce((F.col(col) == yes).cast("double"), F.lit(0.0))


def floor_label(col: str, lo: int = 1, hi: int = 5) -> Column:
    """``min(hi, max(lo, floor(v))) - lo``."""
    return (F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(F.col(col)))) - lo).cast("int")


def observed_classes(df: DataFrame, col: str, max_levels: int = 1000) -> list[float]:
    """B17 fit: sorted distinct observed values."""
    return [float(v) for v in fit_levels(df, [col], max_levels)[col]]


def observed_label(col: str, class_values: Sequence[float], rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """B17 apply: index of the class value within tolerance; unknown fails."""
    v = F.col(col).cast("double")
    expr = None
    for i, cv in enumerate(class_values):
        hit = F.abs(v - F.lit(float(cv))) <= F.lit(atol + rtol * abs(float(cv)))
        expr = F.when(hit, F.lit(i)) if expr is None else expr.when(hit, F.lit(i))
    err = F.raise_error(F.concat(F.lit(f"unknown value for {col}: "), v.cast("string")))
    return err if expr is None else expr.otherwise(err)


def label(df: DataFrame, col: str, mode: str = "floor", out: str = "label",
          class_values: Sequence[float] | None = None) -> tuple[DataFrame, list[float]]:
    """Label-mode switch. Returns (df with ``out``, class values)."""
    if mode == "floor":
        return df.withColumn(out, floor_label(col)), [1.0, 2.0, 3.0, 4.0, 5.0]
    if mode == "separate_fractional":
        cv = list(class_values) if class_values is not None else observed_classes(df, col)
        return df.withColumn(out, observed_label(col, cv)), cv
    raise ValueError(f"unknown label mode {mode!r}; expected one of {LABEL_MODES}")


def binary_target(col: str, threshold: float = 3.0) -> Column:
    """1 when value > threshold."""
    return (F.col(col) > threshold).cast("int")


def assemble(df: DataFrame, cols: Sequence[str]) -> Column:
    """Fixed-order ARRAY<DOUBLE> feature vector; array-valued inputs are
    spliced in place, scalars become one slot."""
    parts = []
    for c in cols:
        dt = df.schema[c].dataType.simpleString()
        parts.append(F.col(c).cast("array<double>") if dt.startswith("array") else F.array(F.col(c).cast("double")))
    return F.concat(*parts)


def class_value(index_col: str, class_values: Sequence[float]) -> Column:
    """Class index -> original value."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in class_values]), F.col(index_col) + 1)


def parent_feature(col: str, parents: Sequence[str], strip_prefix: str = "__") -> Column:
    """Strip a transformer prefix (``num__``/``cat__``) and map a one-hot
    name ``feature_level`` to its parent feature (longest match first)."""
    name = F.regexp_replace(F.col(col), r"^[^_]*" + strip_prefix, "") if strip_prefix else F.col(col)
    expr = name
    out = None
    for p in sorted(parents, key=len, reverse=True):
        cond = (name == F.lit(p)) | name.startswith(F.lit(p + "_"))
        out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
    return expr if out is None else out.otherwise(expr)


def effect_type(term_col: str) -> Column:
    """Main / two-way / three-way by the number of ':' in a term."""
    k = F.regexp_count(F.col(term_col), F.lit(":"))
    return (F.when(k == 0, "main").when(k == 1, "two-way").when(k == 2, "three-way")
            .otherwise(F.concat((k + 1).cast("string"), F.lit("-way"))))


def ci_excludes_zero(lo: str, hi: str) -> Column:
    """Significance flag when the interval excludes 0."""
    return (F.col(lo) > 0) | (F.col(hi) < 0)


def treatment_columns(col: str, levels: Sequence, reference) -> list[Column]:
    """Indicator per non-reference level (named ``col[T.level]``)."""
    return [(F.col(col) == F.lit(lv)).cast("double").alias(f"{col}[T.{lv}]") for lv in levels if lv != reference]


def sum_columns(col: str, levels: Sequence) -> list[Column]:
    """Sum-to-zero coding: indicator(level) - indicator(last level)."""
    last = levels[-1]
    return [((F.col(col) == F.lit(lv)).cast("double") - (F.col(col) == F.lit(last)).cast("double"))
            .alias(f"{col}[S.{lv}]") for lv in levels[:-1]]


def interaction_columns(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Products of coded columns ``a:b``."""
    return df.select("*", *[(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}:{b}") for a in left for b in right])


def unpivot_quantiles(df: DataFrame, col: str, quantiles: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """One row per (row, quantile) from an ARRAY<DOUBLE> of per-quantile
    predictions; the array length is asserted."""
    q = F.array(*[F.lit(float(x)) for x in quantiles])
    checked = df.withColumn("__ok", F.assert_true(F.size(col) == len(quantiles),
                                                  f"prediction array length must equal {len(quantiles)}"))
    return checked.select(*keep, F.posexplode(col).alias("__pos", "prediction")).withColumn(
        "quantile", F.element_at(q, F.col("__pos") + 1)).drop("__pos")


def changed_cells(df: DataFrame, key: Sequence[str], original: Mapping[str, str], proposed: Mapping[str, str]) -> DataFrame:
    """Long table (key..., feature, original, proposed) of the cells that
    differ (null-safe)."""
    feats = list(original)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(original[f]).cast("string").alias("original"),
                             F.col(proposed[f]).cast("string").alias("proposed")) for f in feats])
    return (df.select(*key, F.explode(arr).alias("c")).select(*key, "c.*")
            .where(~F.col("original").eqNullSafe(F.col("proposed"))))
