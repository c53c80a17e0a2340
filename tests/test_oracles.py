"""Every registered query with an SQL oracle agrees with DuckDB on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from core_cases import SF_SMALL

import importlib.util

_spec = importlib.util.spec_from_file_location(
    "oracle_check", os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools", "oracle_check.py"))
_oc = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_oc)

from panelkit.plans import registry  # noqa: E402

registry.load_all()
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in _oc.TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_registered_with_ids():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert all(registry.SURVEY_IDS[n] for n in registry.QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    assert _oc.rows_of(srows, cols) == _oc.rows_of(drows, cols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "equal_response" in df.columns
