"""Toxicity severity by cumulative-link ordinal regression on sparse text.

Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic in a text of low
quality. Features are words and their first 3, 4 and 6 letters (toxic stems
take many endings), valued by their share of the text's words. One weight
vector serves both thresholds; the result is P(grade >= 1), P(grade >= 2),
their sum (the expected severity) and ``toxic``, true from probability one
half on.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS``); every
row is scored.

Cases: null and empty texts have no features and get the base rates; without
labels the probabilities are null and nothing is toxic; an empty table gives
an empty result; rows are independent, so ties, repeats and extra columns need
nothing.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import register, table
from panelkit.llm.cumulative_link import Features, Model, fit_rows, labelled_features, score_udf

WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 6)
#: Labelled rows the model is fitted on.
MAX_ROWS = 4000
#: Values are occurrences in so many words.
PER_WORDS = 30.0


def units(text: str) -> dict[str, float]:
    counts = Counter(WORD.findall(text.lower()))
    each = PER_WORDS / max(1, counts.total())
    return {w: n * each for w, n in counts.items()}


def names(word: str) -> list[str]:
    return [word] + [word[:n] + "~" for n in PREFIXES if n <= len(word)]


FEATURES = Features(units, names)


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) of the labelled rows."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return labels.select(F.col(id_col).cast("long").alias("id"), F.when(toxic == 0, 0).when(
        toxic == 1, F.when(quality == 0, 2).otherwise(1)).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS) -> Model:
    return fit_rows(labelled_features(docs, grades(labels, id_col), id_col, text_col, FEATURES, max_rows), 3)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, p_toxic, p_severe, severity, toxic."""
    p = score_udf(docs.sparkSession, model, FEATURES)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), p(F.col(text_col)).alias("p"))
    return rows.select(id_col, F.col("p")[0].alias("p_toxic"), F.col("p")[1].alias("p_severe"),
                       (F.col("p")[0] + F.col("p")[1]).alias("severity"),
                       F.coalesce(F.col("p")[0] >= 0.5, F.lit(False)).alias("toxic"))


@register("op5_toxicity_ordinal")
def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
