"""Quality by cumulative-link ordinal regression on graded ratings.

Grades come from the labels: 0 low quality, 1 good but toxic, 2 good. Features
are hashed words, runs of punctuation, the share of repeated and of distinct
words, of upper-case words, and the length. One weight vector serves both
thresholds; the result is the expected grade, the tail probability
P(grade >= ``min_grade``) and ``selected``, true from probability one half on.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS`` of
``cumulative_link``); every row is scored.

Cases: null and empty texts only have the length feature; without labels the
probabilities are null and everything is selected; an empty table gives an
empty result; rows are independent, so ties, repeats and extra columns need
nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import register, table
from panelkit.llm.cumulative_link import MAX_ROWS, Features, Model, fit_rows, labelled_features, score_udf

PUNCTUATION = re.compile(r"[^\w\s]+")
L2 = 1e-3
#: Longest run of punctuation told apart.
RUN = 8


def units(text: str) -> dict[str, float]:
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    out: dict[str, float] = {}
    for word, k in counts.items():
        name = "w " + word.lower().strip(".,")
        out[name] = out.get(name, 0.0) + k
    for run, k in Counter(PUNCTUATION.findall(text)).items():
        name = "p " + run[:RUN]
        out[name] = out.get(name, 0.0) + k
    out["repeated"] = sum(a == b for a, b in zip(words, words[1:]))
    out["upper"] = sum(k for w, k in counts.items() if w.isupper())
    out = {name: math.sqrt(k / n) for name, k in out.items()}
    out["distinct"] = len(counts) / n
    out[f"length {int(math.log2(len(words) + 1))}"] = 0.3
    return out


FEATURES = Features(units)


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) of the labelled rows."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return labels.select(F.col(id_col).cast("long").alias("id"), F.when(quality == 0, 0).when(
        quality == 1, F.when(toxic == 1, 1).otherwise(2)).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS) -> Model:
    return fit_rows(labelled_features(docs, grades(labels, id_col), id_col, text_col, FEATURES, max_rows), 3, L2)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_grade: int = 1) -> DataFrame:
    """Per row: id, expected_grade, p_tail, selected."""
    p = score_udf(docs.sparkSession, model, FEATURES)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), p(F.col(text_col)).alias("p"))
    at = F.col("p")[min_grade - 1]
    return rows.select(id_col, (F.col("p")[0] + F.col("p")[1]).alias("expected_grade"), at.alias("p_tail"),
                       F.coalesce(at >= 0.5, F.lit(True)).alias("selected"))


def selected_rows(docs: DataFrame, model: Model, text_col: str = "text", min_grade: int = 1) -> DataFrame:
    """The rows of ``docs`` that are selected; all columns, no shuffle."""
    p = score_udf(docs.sparkSession, model, FEATURES)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, p(F.col(text_col)).alias("p"))
    return rows.where(F.coalesce(F.col("p")[min_grade - 1] >= 0.5, F.lit(True))).select("row.*")


@register("op7_quality_ordinal")
def op7_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
