"""From raw documents to token ids, in five stages.

Every stage takes the documents its predecessor kept and returns the same
columns (the last one returns token counts and digests). ``run`` writes each
result as Parquet into the shared folder and reads it back, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import bpe_prefix, decontaminate, exact_dedup, quality_ordinal, simhash_bk
from panelkit.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, selects."""
    return quality_ordinal.selected_rows(docs, quality_ordinal.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every set of equal texts."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of linked fingerprints."""
    return simhash_bk.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    ranks = bpe_prefix.load_ranks(public_tokenizers.path(bpe_prefix.RANK_FILE))
    return bpe_prefix.encode_decode(docs, "doc_id", "text", ranks)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("benchmark decontamination", clean),
    ("byte-level BPE", encode),
]

#: A fitted classifier, XXH64 fingerprints and BPE merges have no SQL form;
#: tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
