"""Portable pseudo-randomness: a uniform in [0, 1) from the md5 of a key.

Same value in Spark and in DuckDB (``('0x'||substr(md5(s),1,13))::bigint /
power(16,13)``), deterministic under task retries and independent of
partitioning - unlike ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def portable_uniform(*parts) -> Column:
    """Uniform in [0,1) from md5 of ``concat_ws(':', parts)``."""
    h = F.substring(F.md5(hash_key(*parts)), 1, 13)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(float(16**13))


def uniform_sql(*parts: str) -> str:
    """The DuckDB text of :func:`portable_uniform` for oracle queries (parts are SQL expressions)."""
    key = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / power(16, 13))"


def fast_uniform(*parts) -> Column:
    """Uniform in [0,1) from ``xxhash64`` of the parts: JVM-native and cheap,
    deterministic under retries; used where no cross-engine oracle is needed
    (e.g. bootstrap bands)."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftright(h, 11).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
