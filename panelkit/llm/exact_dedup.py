"""Exact dedup: group by a 128-bit content hash, compare bytes inside the
groups, keep one row by a stable id. DataFrame functions only.

Two texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``. The row with the most code points in its original text
stays; ties go to the smallest id.

Plan: one aggregation on (128-bit hash, text). The hash spreads the rows and
the text in the key makes Spark compare the bytes, so two texts that share a
hash never share a group. Copies are combined map-side: a text that a third of
all rows hold reaches the shuffle once per map task. The groups then meet the
documents on (hash, SHA-256), without texts.

Cases: a null text counts as empty, and all empty texts form one group. A null
id sorts after every id. Rows that repeat both id and text all count in
``group_size``; they can't be told apart, so each carries ``kept`` of its id,
and ``keep_rows`` leaves one of them. An empty table gives an empty result.
Extra columns are ignored by ``exact_groups`` and kept by ``keep_rows``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import register, table, text_or_empty

WHITE = " \t\n\x0b\x0c\r"
_SPAN = "36893488147419103232"  # 2**65: more than any two ids, or an id and a null, differ


def without_white(text: Column) -> Column:
    """The text with every character of ``[\\x20\\x09-\\x0D]`` deleted."""
    out = text
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash128: Callable[[Column], Column]) -> DataFrame:
    text = text_or_empty(docs[text_col])
    slim = docs.select(docs[id_col].cast("long").alias("id"), without_white(text).alias("norm"),
                       F.length(text).alias("points"))
    return slim.withColumn("hash", hash128(F.col("norm")))


def _groups(keyed: DataFrame) -> DataFrame:
    """One row per distinct text: hash, sha, size, points and id of the row
    that stays. ``order`` packs (points desc, id asc) into one decimal, which a
    hash aggregate can hold; a null id takes the last place of its points."""
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    last = F.lit("18446744073709551616").cast("decimal(20,0)")
    place = F.coalesce(F.col("id").cast("decimal(20,0)") + half, last)
    base = F.col("points").cast("decimal(10,0)") * F.lit(_SPAN).cast("decimal(20,0)")
    best = (
        keyed.withColumn("order", (base - place).cast("decimal(34,0)"))
        .groupBy("hash", "norm")
        .agg(F.count(F.lit(1)).alias("size"), F.max("points").alias("points"), F.max("order").alias("order"))
        .withColumn("place", base - F.col("order"))
    )
    return best.select(
        "hash", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "size",
        F.col("points").alias("keep_points"),
        F.when(F.col("place") < last, (F.col("place") - half).cast("long")).alias("keep_id"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept,
    text_sha256 (hex SHA-256 of the text without white space)."""
    keyed = _keyed(docs, id_col, text_col, hash128)
    groups = _groups(keyed)
    rows = keyed.select("id", "points", "hash", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    return rows.join(groups, ["hash", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one row per distinct text.

    The texts are dealt by id, never by hash, so a hot text is never gathered.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = text_or_empty(docs[text_col])
    norm = without_white(text)
    full = docs.select(row, docs[id_col].cast("long").alias("id"), F.length(text).alias("points"),
                       F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha"))
    best = _groups(_keyed(docs, id_col, text_col, hash128)).select(
        F.col("keep_id").alias("k_id"), F.col("sha").alias("k_sha"), F.col("keep_points").alias("k_points"))
    same = (F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha"))
            & (F.col("points") == F.col("k_points")))
    met = full.join(best, same, "left_semi")
    first = Window.partitionBy("id", "sha").orderBy("points")
    return (met.withColumn("nth", F.row_number().over(first)).where("nth = 1")
            .select("row.*"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         sha256(norm) AS text_sha256
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@register("op8_exact_dedup", ORACLE)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row of its group that stays."""
    return exact_groups(table(spark, sf_dir, "documents"))
