"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in regions and shards in racks. A row's key descends
level by level: every child of the node reached draws ``-ln(u) / weight``,
``u`` a uniform hash of (child, key), and the least draw wins. A child's draw
depends on its own weight alone, so

* no row moves between the children of a node whose weights stay;
* a heavier shard takes rows into its rack and region and loses none, and rows
  move only along the paths whose weights changed (a row that enters a region
  by the heavier region weight may land on any of its shards);
* a shard that opens a region of its own takes rows only into itself. That is
  how ``tree`` grows beyond the shards it was ``built`` with.

Law: ``key``. The key and the tree decide the shard, in one projection without
a shuffle. ``placements`` also numbers each shard's rows without gaps: equal
slim rows (id, size, CRC) are counted map-side, ordered by a hash of the slim
row, cut into hash ranges that each fit a task, and offset by the prefix sum of
the ranges. The hash covers the whole slim row, so an id that a third of all
rows share is spread over the ranges of its shard. ``write_shards`` writes the
whole rows by region, rack and shard; a hot shard is spread over many tasks.

Cases: a null id is a key of its own (one shard); a null text has size 8 and
CRC 0, like an empty one; rows that share an id share a shard; rows that repeat
id, size and CRC take adjacent slots (they can't be told apart); a shard
without weight draws nothing; an empty table gives an empty result; extra
columns are ignored by ``placements`` and kept, whatever their names, by
``write_shards``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import checkpointed, register, table, text_or_empty

SHARDS = 24
RACKS = 2  # per region
PER_RACK = 4
LAW = "key"
#: Rows of one numbering task, at about; more ranges beyond it.
RANGE_ROWS = 200_000
#: Equal rows expanded by one task at a time.
CHUNK = 1 << 16
HEX = 13


class Shard(NamedTuple):
    region: str
    rack: str
    number: int
    weight: float = 1.0


def tree(shards: int = SHARDS, built: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> list[Shard]:
    """Shards 0 to ``built`` - 1 fill regions of ``racks`` racks; every later
    one opens a region of its own."""
    out = []
    for n in range(shards):
        if n < built:
            out.append(Shard(f"r{n // (racks * per_rack)}", f"k{n // per_rack % racks}", n))
        else:
            out.append(Shard(f"g{n}", "k0", n))
    return out


class Child(NamedTuple):
    path: str
    weight: float
    at: int


def levels(shards: list[Shard]) -> tuple[list[Child], list[list[Child]], list[list[Child]], list[str]]:
    """(regions, racks by region, shards by rack, names): children of every
    node, with their weights summed upwards; nodes without weight left out."""
    weigh: dict[tuple, float] = {}
    for s in shards:
        if s.weight > 0:
            for path in ((s.region,), (s.region, s.rack)):
                weigh[path] = weigh.get(path, 0.0) + s.weight
    regions = [p for p in weigh if len(p) == 1]
    racks = [p for p in weigh if len(p) == 2]
    top = [Child(p[0], weigh[p], i) for i, p in enumerate(regions)]
    middle = [[Child("/".join(k), weigh[k], racks.index(k)) for k in racks if k[:1] == p] for p in regions]
    leaves = [[Child(f"{s.region}/{s.rack}/{s.number}", s.weight, s.number) for s in shards
               if (s.region, s.rack) == k and s.weight > 0] for k in racks]
    return top, middle, leaves, [p[0] for p in regions]


def _children(found: list[Child]) -> Column:
    return F.array(*[F.struct(F.lit(c.path).alias("path"), F.lit(float(c.weight)).alias("weight"), F.lit(c.at).alias("at")) for c in found])


def _draw(children: Column, key: Column) -> Column:
    """``at`` of the child with the least weighted draw."""
    def one(c: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws(":", c["path"], key).cast("binary")), 1, HEX), 16, 10).cast("bigint")
        u = (h.cast("double") + F.lit(0.5)) / F.lit(float(16 ** HEX))
        return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c["at"].alias("at"))
    return F.array_min(F.transform(children, one))["at"]


def key_of(id_col: Column) -> Column:
    return F.coalesce(id_col.cast("string"), F.lit("null"))


def placed(rows: DataFrame, key: Column, shards: list[Shard], out: str) -> DataFrame:
    """Add ``out``: the shard of ``key``, a descent of three draws."""
    top, middle, leaves, _ = levels(shards)
    if not top:
        return rows.withColumn(out, F.lit(None).cast("int"))
    region, rack = f"{out}_region", f"{out}_rack"
    rows = rows.withColumn(region, _draw(_children(top), key))
    rows = rows.withColumn(rack, _draw(F.element_at(F.array(*[_children(m) for m in middle]), F.col(region) + 1), key))
    rows = rows.withColumn(out, _draw(F.element_at(F.array(*[_children(m) for m in leaves]), F.col(rack) + 1), key))
    return rows.drop(region, rack)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(docs[text_col])
    return docs.select(docs[id_col].cast("long").alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"))


def _spread(id_col: Column, size: Column, crc: Column) -> Column:
    """32-bit hash of a slim row: the order of the slots."""
    text = F.concat_ws(":", key_of(id_col), size.cast("string"), crc.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def with_slots(counted: DataFrame, ranges: int, chunk: int) -> DataFrame:
    """``counted`` (id, size, crc, shard, ..., n): one row per row, with its
    ``slot`` in the shard."""
    ordered = counted.withColumn("h", _spread(F.col("id"), F.col("size"), F.col("crc"))) \
        .withColumn("range", F.shiftright(F.col("h") * F.lit(ranges), 32))
    within = Window.partitionBy("shard", "range").orderBy("h", F.col("id").asc_nulls_last(), "size", "crc") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = checkpointed(ordered.withColumn("start", F.sum("n").over(within) - F.col("n")))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard and range
    offsets = run.groupBy("shard", "range").agg(F.sum("n").alias("m")) \
        .select(F.col("shard").alias("o_shard"), F.col("range").alias("o_range"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    met = run.join(offsets, F.col("shard").eqNullSafe(F.col("o_shard")) & (F.col("range") == F.col("o_range")))
    parts = met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {chunk}"))))
    # equal rows may be very many: their parts go to different tasks
    dealt = parts.repartition(F.col("h"), F.col("part"))
    last = F.least(F.lit(chunk).cast("long"), F.col("n") - F.col("part") * chunk) - 1
    return dealt.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last))) \
        .withColumn("slot", F.col("offset") + F.col("start") + F.col("part") * chunk + F.col("at"))


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: list[Shard] | None = None,
               grown: list[Shard] | None = None, range_rows: int = RANGE_ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot and
    grown_shard, the shard in the tree ``grown`` (null without one)."""
    shards = tree() if shards is None else shards
    slim = _slim(docs, id_col, text_col)
    ranges = slim.count() // (max(1, len(shards)) * range_rows) + 1
    counted = placed(slim.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n")), key_of(F.col("id")), shards, "shard")
    counted = placed(counted, key_of(F.col("id")), grown, "grown") if grown else counted.withColumn("grown", F.lit(None).cast("int"))
    return with_slots(counted, ranges, chunk).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
        F.col("grown").alias("grown_shard"))


def moves(docs: DataFrame, before: list[Shard], after: list[Shard], id_col: str = "doc_id") -> DataFrame:
    """Rows per (from_shard, to_shard) when the tree changes."""
    ids = docs.groupBy(docs[id_col].cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    both = placed(placed(ids, key_of(F.col("id")), before, "from_shard"), key_of(F.col("id")), after, "to_shard")
    return both.groupBy("from_shard", "to_shard").agg(F.sum("n").alias("rows"))


def write_shards(docs: DataFrame, path: str, shards: list[Shard] | None = None, id_col: str = "doc_id", spread: int = 16) -> None:
    """Write all rows and columns (as the struct ``row``) by region, rack and
    shard; ``spread`` tasks share the rows of a shard. Placement needs the
    ids only, so reading one shard is ``read_shard``."""
    shards = tree() if shards is None else shards
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = placed(docs.select(row, docs[id_col].cast("long").alias("id")), key_of(F.col("id")), shards, "shard")
    names = F.create_map(*[x for s in shards for x in (F.lit(s.number), F.struct(F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack")))])
    rows = rows.withColumn("home", names[F.col("shard")]).withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(spread)))
    rows.repartition("shard", "deal").select("row", "home.region", "home.rack", "shard") \
        .write.partitionBy("region", "rack", "shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard, from its folder alone."""
    return spark.read.parquet(path).where(F.col("shard") == shard).select("row.*")


def _oracle(shards: list[Shard], grown: list[Shard]) -> str:
    """The same in DuckDB SQL."""
    def descent(name: str, of: list[Shard]) -> str:
        top, middle, leaves, _ = levels(of)
        rows = [(0, 0, *c) for c in top] + [(1, i, *c) for i, m in enumerate(middle) for c in m] \
            + [(2, i, *c) for i, m in enumerate(leaves) for c in m]
        values = ", ".join(f"({lv}, {p}, '{path}', {w}::DOUBLE, {at})" for lv, p, path, w, at in rows)
        uniform = f"(CAST(('0x' || substr(md5(path || ':' || key), 1, {HEX})) AS BIGINT) + 0.5::DOUBLE) / {float(16 ** HEX)!r}::DOUBLE"
        out = f"{name}_node(level, parent, path, weight, nxt) AS (VALUES {values}),\n{name}_0 AS (SELECT key, 0 AS reached FROM keys)"
        for lv in range(3):
            out += (f",\n{name}_{lv + 1} AS (SELECT key, arg_min(nxt, -ln({uniform}) / weight) AS reached "
                    f"FROM {name}_{lv} JOIN {name}_node ON parent = reached AND level = {lv} GROUP BY key)")
        return out

    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, hex(encode(coalesce(text, ''))) AS x FROM documents),
slim AS (SELECT doc_id, key, CAST(length(x) // 2 + 8 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS BIGINT) AS crc FROM raw, tab),
keys AS (SELECT DISTINCT key FROM raw),
{descent('now', shards)},
{descent('more', grown)}
SELECT doc_id, size, crc AS text_crc32, '{LAW}' AS law, CAST(now_3.reached AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY now_3.reached ORDER BY substr(md5(key || ':' || size || ':' || crc), 1, 8), doc_id NULLS LAST, size, crc) - 1 AS slot,
    CAST(more_3.reached AS INTEGER) AS grown_shard
FROM slim JOIN now_3 USING (key) JOIN more_3 USING (key)"""


ORACLE = _oracle(tree(SHARDS), tree(SHARDS + 1))


@register("op11_hash_tree", ORACLE)
def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of ``documents``, and its shard with one more."""
    return placements(table(spark, sf_dir, "documents"), grown=tree(SHARDS + 1))
