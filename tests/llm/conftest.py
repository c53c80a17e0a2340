import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from llm_cases import SF_MID


@pytest.fixture(scope="session")
def spark():
    from panelkit.session import local_session

    s = local_session(cpus="*", partitions=8)
    yield s


@pytest.fixture(scope="session")
def texts():
    """Whole texts of the small documents table."""
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(f"{SF_MID}/documents.parquet")["text"].to_pylist()]


@pytest.fixture
def docs(spark):
    """rows (doc_id, text) -> DataFrame with extra columns whose names clash
    with those the operators use inside."""

    def make(rows, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            names = ("id", "hash", "norm", "size", "n", "row", "h", "w", "fp", "rep", "p", "k", "nth", "sha", "points")
            df = df.withColumns({c: F.lit(i) for i, c in enumerate(names)})
        return df

    return make
