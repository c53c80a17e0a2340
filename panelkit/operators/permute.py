"""Permuted copies of columns without a row per copy in any shuffle (survey H6, L2).

Numbered rows are cut into blocks of consecutive numbers. A block sends the
values of all copies to each other block in one record, ordered by the sender's
numbers; the receiver knows that order from the inverse of the keyed bijection
(:func:`split.with_bijection`), so a value travels without number or name.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelkit.operators import split
from panelkit.session import materialize

#: Rows per block: at most, and at least where cores are idle.
BLOCK_ROWS, LEAST_ROWS = 262_144, 1_024
#: Distinct values up to which a column that is not a number travels as codes.
LEVELS = 1_000
#: Rows that leave a worker at a time.
OUT_ROWS = 5_000

_NUMBERS = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}


class Bijection:
    """:func:`split.with_bijection` and its inverse in numpy: the round functions
    are tables over the digits."""

    def __init__(self, n: int, keys: Sequence[int]):
        self.n, (self.w, self.h) = n, split._base(n)
        self.kind = np.int32 if n < 2**30 else np.int64

        def table(r: int, digits: int, modulus: int) -> np.ndarray:
            a, b, c = keys[3 * r:3 * r + 3]
            t = (a * (np.arange(digits, dtype=np.int64) % split._PRIME + 1) + b) % split._PRIME
            return ((t * t + c) % split._PRIME % modulus).astype(self.kind)

        self.tables = [table(r, self.h if r % 2 else self.w, self.w if r % 2 else self.h) for r in range(split.ROUNDS)]

    def digits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.divmod(x, self.w)
        return high.astype(self.kind), low.astype(self.kind)

    def _walk(self, out: np.ndarray, once: Callable) -> np.ndarray:
        far = np.flatnonzero(out >= self.n)
        while len(far):
            out[far] = once(*self.digits(out[far]))
            far = far[out[far] >= self.n]
        return out

    def _to(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        for r, table in enumerate(self.tables):
            if r % 2:
                low = low + table[high]
                low -= (low >= self.w) * self.kind(self.w)
            else:
                high = high + table[low]
                high -= (high >= self.h) * self.kind(self.h)
        return high.astype(np.int64) * self.w + low

    def _from(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        for r in reversed(range(split.ROUNDS)):
            if r % 2:
                low = low - self.tables[r][high]
                low += (low < 0) * self.kind(self.w)
            else:
                high = high - self.tables[r][low]
                high += (high < 0) * self.kind(self.h)
        return high.astype(np.int64) * self.w + low

    def to(self, digits: tuple) -> np.ndarray:
        """Where numbers, given as digits, go."""
        return self._walk(self._to(*digits), self._to)

    def back(self, digits: tuple) -> np.ndarray:
        """Where they come from."""
        return self._walk(self._from(*digits), self._from)


@dataclass
class _Column:
    """How a column travels: as a number, else (``levels``) as its code, null last."""

    name: str
    kind: type
    nulls: bool
    levels: list | None = None

    def packed(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        if self.levels is not None:
            code = pc.index_in(column, value_set=pa.array(self.levels, column.type)).fill_null(len(self.levels))
            return code.to_numpy(zero_copy_only=False).astype(self.kind), None
        null = column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) if self.nulls else None
        return (column.fill_null(0) if self.nulls else column).to_numpy(zero_copy_only=False).astype(self.kind, copy=False), null


def _columns(df: DataFrame, features: Sequence[str]) -> list[_Column] | None:
    """How the features travel, or None if one has too many values for codes."""
    types = {f: df.schema[f].dataType for f in features}
    some = df.agg(*[F.count_if(F.col(f).isNull()).alias(f"__{j}") for j, f in enumerate(features)]).first()
    out = []
    for j, f in enumerate(features):
        if kind := _NUMBERS.get(types[f].simpleString()):
            out.append(_Column(f, kind, bool(some[j])))
            continue
        rows = df.select(f).where(F.col(f).isNotNull()).distinct().limit(LEVELS + 1).collect()
        levels = [r[0] for r in rows]
        if len(levels) > LEVELS or not all(isinstance(v, (str, bool, datetime.date, decimal.Decimal)) and not isinstance(v, datetime.datetime) for v in levels):
            return None
        out.append(_Column(f, np.uint8 if len(levels) < 255 else np.uint16, False, levels))
    return out


def _hundredths(v: np.ndarray) -> np.ndarray | None:
    """Doubles that are whole hundredths of a small number as integers, from which
    :func:`_doubles` makes the same bits."""
    if v.dtype != np.float64 or not len(v):
        return None
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.rint(v * 100)
        if not (np.abs(x) < 2**31).all():
            return None
        x = x.astype(np.int32)
    return x if ((x / 100).view(np.int64) == np.ascontiguousarray(v).view(np.int64)).all() else None


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _blocks(numbered: DataFrame, size: int, n: int) -> DataFrame:
    """One record (block, rows) per block, its rows in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [b for b in batches if b.num_rows]:
            rows = _one(got)
            at = rows.schema.get_field_index("__i")
            first = rows.column(at)[0].as_py()
            assert first % size == 0 and rows.num_rows == min(size, n - first)  # a partition is a block
            rest = pa.RecordBatch.from_arrays([c for j, c in enumerate(rows.columns) if j != at], [f for j, f in enumerate(rows.schema.names) if j != at])
            yield pa.RecordBatch.from_arrays([pa.array([first // size], pa.int32()), pa.array([_ipc(rest)], pa.binary())], ["block", "rows"])

    block = F.call_function("div", F.col("__i"), F.lit(size)).cast("int")
    dealt = numbered.repartitionById(-(-n // size), block).sortWithinPartitions("__i")
    return materialize(dealt.mapInArrow(run, "block int, rows binary"))


def _keys(features: Sequence[str], repeats: int, seed: int) -> list[tuple[int, list[int]]]:
    """(feature's place, round keys) of every copy."""
    return [(j, split.bijection_keys(seed, f, r)) for j, f in enumerate(features) for r in range(1, repeats + 1)]


def _sent(blocks: DataFrame, columns: list[_Column], keys: list, size: int, n: int) -> DataFrame:
    """Records (to, from, data): the rows of a block to itself (from -1), the values
    of all copies to every block."""
    count = -(-n // size)
    small = np.uint8 if count <= 256 else np.uint16 if count <= 65536 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(*(c.to_pylist() for c in b.columns)):
                rows = _read(data)
                numbers, scaled, streams = np.arange(block * size, block * size + rows.num_rows), [], []
                values = [c.packed(rows.column(rows.schema.get_field_index(c.name))) for c in columns]
                for j, (v, null) in enumerate(values):
                    x = _hundredths(v)
                    scaled.append(x is not None)
                    values[j] = (v if x is None else x, null)
                digits = Bijection(n, keys[0][1]).digits(numbers)
                for j, key in keys:
                    to = (Bijection(n, key).to(digits) // size).astype(small)
                    order, ends = np.argsort(to, kind="stable"), np.r_[0, np.cumsum(np.bincount(to, minlength=count))]
                    streams += [(memoryview(v[order]).cast("B"), ends * v.itemsize) for v in values[j] if v is not None]
                yield _record([block], [-1], [data])
                for k in range(count):
                    yield _record([k], [block], [bytes(scaled) + b"".join(s[e[k]:e[k + 1]] for s, e in streams)])

    return blocks.mapInArrow(run, "to int, from int, data binary")


def _record(to: list, source: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(source, pa.int32()), pa.array(data, pa.binary())], ["to", "from", "data"])


def _received(batches: Iterator[pa.RecordBatch], columns: list[_Column], keys: list, size: int, n: int):
    """(rows, copies) per block, copies an iterator of (copy, feature's place,
    values, nulls) in the order of the rows."""
    count, got = -(-n // size), {}
    for b in batches:
        for to, source, data in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(to, {})[source] = data

    def copies(block: int, parts: dict, rows: int):
        views = [memoryview(parts[s]) for s in range(count)]
        scaled = [[bool(x) for x in v[:len(columns)]] for v in views]
        at = [len(columns)] * count
        digits = Bijection(n, keys[0][1]).digits(np.arange(block * size, block * size + rows))
        for c, (j, key) in enumerate(keys):
            source = Bijection(n, key).back(digits)
            order, many = np.argsort(source), np.bincount(source // size, minlength=count)
            out, nulls = np.empty(rows, columns[j].kind), None

            def stream(kind) -> np.ndarray:
                pieces = []
                for s in range(count):
                    as_sent = np.int32 if kind is np.float64 and scaled[s][j] else kind  # noqa: B023
                    end = at[s] + int(many[s]) * np.dtype(as_sent).itemsize  # noqa: B023
                    x = np.frombuffer(views[s][at[s]:end], as_sent)
                    pieces.append(x / 100 if as_sent is not kind else x)
                    at[s] = end
                return np.concatenate(pieces)

            out[order] = stream(columns[j].kind)
            if columns[j].nulls:
                nulls = np.empty(rows, bool)
                nulls[order] = stream(np.uint8)
            yield c, j, out, nulls

    for block, parts in sorted(got.items()):
        rows = _read(parts.pop(-1))
        yield rows, copies(block, parts, rows.num_rows)


@dataclass
class Permuted:
    """Numbered rows in blocks and what their permuted copies need."""

    blocks: DataFrame
    schema: object
    columns: list[_Column]
    keys: list
    size: int
    n: int
    repeats: int

    def _dealt(self) -> DataFrame:
        return _sent(self.blocks, self.columns, self.keys, self.size, self.n).repartitionById(-(-self.n // self.size), F.col("to"))

    def copies(self) -> DataFrame:
        """Every row once per copy (``__copy``: feature's place x repeats + repeat), with
        the permuted value in place of its own, and once as it is (the copy after the last)."""
        columns, keys, size, n, repeats = self.columns, self.keys, self.size, self.n, self.repeats
        kinds = [np.int32 if c.levels is not None else c.kind for c in columns]
        names = {np.dtype(v): k for k, v in _NUMBERS.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, copies in _received(batches, columns, keys, size, n):
                values = [np.empty((repeats, rows.num_rows), c.kind) for c in columns]
                nulls = [np.zeros((repeats, rows.num_rows), bool) if c.nulls else None for c in columns]
                for c, j, v, null in copies:
                    values[j][c % repeats] = v
                    if null is not None:
                        nulls[j][c % repeats] = null
                for at in range(0, rows.num_rows, OUT_ROWS):
                    some = rows.slice(at, OUT_ROWS)
                    ends = pa.array(np.arange(some.num_rows + 1) * repeats, pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v[:, at:at + OUT_ROWS].T).ravel().astype(k, copy=False),
                                                                     mask=None if x is None else x[:, at:at + OUT_ROWS].T.ravel()))
                             for v, x, k in zip(values, nulls, kinds)]
                    yield pa.RecordBatch.from_arrays([*some.columns, *lists], [*some.schema.names, *[f"__src{j}" for j in range(len(columns))]])

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema] + [f"__src{j} array<{names[np.dtype(k)]}>" for j, k in enumerate(kinds)])
        d = self._dealt().mapInArrow(run, schema).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(keys)))).alias("__copy"))
        place, repeat = F.floor(F.col("__copy") / repeats), F.col("__copy") % repeats
        for j, c in enumerate(columns):
            sent = F.get(f"__src{j}", repeat)
            if c.levels is not None:
                sent = F.get(F.lit(c.levels) if c.levels else F.array(F.lit(None)).cast(f"array<{self.schema[c.name].dataType.simpleString()}>"), sent)
            d = d.withColumn(c.name, F.when(place == j, sent).otherwise(F.col(c.name)))
        return d.drop(*[f"__src{j}" for j in range(len(columns))])

    def table_errors(self, y: str, sizes: Sequence[int], table: np.ndarray) -> DataFrame:
        """(copy, sum, n) of |y - prediction| over rows with a y, per block. All columns
        are codes below ``sizes``; ``table`` has the prediction of every combination."""
        columns, keys, size, n = self.columns, self.keys, self.size, self.n
        step = np.r_[np.cumprod(np.asarray(sizes, np.int64)[::-1])[::-1][1:], 1]
        shared = self.blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table, float).ravel())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, copies in _received(batches, columns, keys, size, n):
                target = rows.column(rows.schema.get_field_index(y))
                known = target.is_valid().to_numpy(zero_copy_only=False)
                target = target.to_numpy(zero_copy_only=False)[known].astype(float)
                own = [c.packed(rows.column(rows.schema.get_field_index(c.name)))[0][known].astype(np.int64) * step[j] for j, c in enumerate(columns)]
                cell = sum(own)
                rest, out = [cell - x for x in own], [(len(keys), shared.value[cell])]
                sums = [(len(keys), float(np.abs(target - out[0][1]).sum()))]
                for c, j, v, _ in copies:
                    sums.append((c, float(np.abs(target - shared.value[rest[j] + v[known] * step[j]]).sum())))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sums], pa.int32()), pa.array([x for _, x in sums], pa.float64()),
                                                  pa.array([len(target)] * len(sums), pa.int64())], ["__copy", "sum", "n"])

        return self._dealt().mapInArrow(run, "__copy int, sum double, n long")


def permuted(df: DataFrame, key: str, features: Sequence[str], repeats: int, seed: int) -> Permuted | None:
    """Number the rows by ``key`` and lay them out in blocks; None for rows that cannot
    travel packed (column types, too many values of a feature that is no number)."""
    features = list(features)
    try:
        for f in df.schema:
            to_arrow_type(f.dataType)
    except PySparkException:
        return None
    if len(set(features)) < len(features) or any(f.dataType.typeName() == "udt" for f in df.schema):
        return None
    mine = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    src = df.persist() if mine else df
    try:
        n = src.count()
        columns = _columns(src, features) if n and features else None
        if columns is None:
            return None
        cores = src.sparkSession.sparkContext.defaultParallelism
        size = max(min(BLOCK_ROWS, -(-n // (2 * cores))), LEAST_ROWS)
        numbered = split.ranks.row_number(src, [key], out="__i").withColumn("__i", (F.col("__i") - 1).cast("bigint"))
        return Permuted(_blocks(numbered, size, n), df.schema, columns, _keys(features, repeats, seed), size, n, repeats)
    finally:
        if mine:
            src.unpersist()
