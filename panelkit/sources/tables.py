"""Scans, guards and sinks (survey 2.A)."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Scan one table (A1), with the missing-path guard (A4).

    Explicit ``schema`` avoids inference; ``columns`` prunes at the scan.
    CSV takes ``header=True`` by default.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        options = {"header": "true", **options}
    try:
        df = reader.options(**options).load(path)
    except AnalysisException as exc:  # A4: re-raise with the path
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"input table not found: {path}") from exc
        raise
    if columns is not None:
        require_columns(df, columns)
        df = df.select(*columns)
    return df


def read_variants(
    spark: SparkSession,
    paths: dict[str, str] | Iterable[str],
    variant_col: str = "variant",
    **kwargs,
) -> DataFrame:
    """Multi-variant scan (A2): union of several files tagged by their stem."""
    if not isinstance(paths, dict):
        paths = {os.path.splitext(os.path.basename(p.rstrip("/")))[0]: p for p in paths}
    frames = [read_table(spark, p, **kwargs).withColumn(variant_col, F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Required-column guard (A3); raises listing the missing names (G3 on name sets)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Non-empty guard (A3). ``isEmpty`` reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column (A5 option)."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, digits: int | None = None, mode: str = "overwrite") -> None:
    """CSV sink with header (A5); optional rounding of float columns."""
    if digits is not None:
        df = rounded(df, digits)
    df.write.mode(mode).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink for metric / report tables."""
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Result-table sink (A7, A9: ``partition_by`` the group key)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
