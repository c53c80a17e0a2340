"""Scan guards (A3, A4) and variant scan (A2)."""

import pytest

from panelkit.sources import tables

from core_cases import SF_SMALL


def test_missing_path_raises(spark):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, "/nonexistent/path/table.parquet")


def test_required_columns(spark):
    df = tables.read_table(spark, f"{SF_SMALL}/lineitem.parquet", columns=["l_orderkey", "l_quantity"])
    assert df.columns == ["l_orderkey", "l_quantity"]
    with pytest.raises(ValueError, match="missing required columns"):
        tables.require_columns(df, ["l_orderkey", "Trust1"])
    with pytest.raises(ValueError):
        tables.require_rows(df.where("l_orderkey < 0"))


def test_variants_tagged_by_stem(spark):
    both = tables.read_variants(spark, [f"{SF_SMALL}/region.parquet", f"{SF_SMALL}/nation.parquet"])
    got = {r["variant"] for r in both.select("variant").distinct().collect()}
    assert got == {"region", "nation"}
