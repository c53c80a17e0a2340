"""Small Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def literal_map(mapping: Mapping) -> Column:
    """A literal MapType column from a (small, driver-side) dict."""
    keys = list(mapping.keys())
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(mapping[k]) for k in keys]))


def literal_table(spark, rows, names, types=None):
    """A small constant table built JVM-side (``inline`` of literal structs,
    folded to a local relation) - no Python RDD, no Python workers.
    ``types`` optionally casts each column (e.g. ``"int"``, ``"array<int>"``)."""
    from pyspark.sql import functions as F

    types = types or [None] * len(names)

    def lit(v, t):
        c = F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        return c.cast(t) if t else c

    structs = [F.struct(*[lit(v, t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
