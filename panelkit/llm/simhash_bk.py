"""SimHash near-dedup with shards of BK-trees.

Fingerprint: words of the text with A-Z lowered, ``shingle`` words joined by a
space, XXH64 (seed 42) of each, a bit set when over half the hashes have it.
Rows with one fingerprint are one node; its representative is their least id.

Shards: 64 bits are cut into ``RADIUS + 2`` blocks. Two fingerprints within
the radius agree in at least two whole blocks, so every pair of blocks gives
one table of buckets keyed by those two blocks, and every linked pair meets in
some bucket (exact, for any data). A bucket is a shard: its fingerprints form
a BK-tree, children keyed by their Hamming distance to the parent, and a query
follows only edges within the radius of its own distance. A bucket of more
than ``SHARD`` fingerprints is salted into parts; every part is a shard, and so
is every pair of parts, one queried by the other. The trees travel by shuffle,
not by driver broadcast: all fingerprints together have no size bound, a shard
has one (twice ``SHARD``).

Links: a tree keeps its members' components while it is built, so a shard
sends one link per member (to the root of its component), and a query one per
component it touches; never all pairs. ``connected_components`` does the rest.

Cases: a null or empty text has fingerprint zero and links like any other; a
null id links like any other, gets the component of its fingerprint and never
names one (null when no row of the component has an id); repeated rows share a component; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import checkpointed, register, table
from panelkit.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
SHARD = 4096
#: Hashes whose bits are unpacked at a time.
BITS_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z, only \x20 and \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(g), 42) for g in grams), ">u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BITS_AT_ONCE):
        ones += np.unpackbits(hashes[at:at + BITS_AT_ONCE].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = [signed(fingerprint(t, shingle)) for t in pdf["text"].fillna("")]
            yield pd.DataFrame({"id": pdf["id"].array, "fp": np.array(fps, np.int64)})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "id long, fp long")


class BKTree:
    """Fingerprints by distance to their parent, with the components that
    links within the radius join."""

    def __init__(self, radius: int):
        self.radius = radius
        self.keys: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.up: list[int] = []  # parents of the component forest

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def near(self, key: int) -> list[int]:
        """Nodes within the radius; only edges within the radius of the
        distance are followed."""
        if not self.keys:
            return []
        radius, keys, kids = self.radius, self.keys, self.kids
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            d = (keys[node] ^ key).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in kids[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found

    def add(self, key: int) -> None:
        hits = self.near(key)
        new = len(self.keys)
        self.keys.append(key)
        self.kids.append({})
        self.up.append(new)
        for h in hits:
            a, b = self.find(h), self.find(new)
            if a != b:
                self.up[max(a, b)] = min(a, b)
        node = 0
        while new:
            d = (self.keys[node] ^ key).bit_count()
            child = self.kids[node].get(d)
            if child is None:
                self.kids[node][d] = new
                break
            node = child


def block_masks(blocks: int) -> list[int]:
    """One 64-bit mask per pair of blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [a | b for a, b in combinations(single, 2)]


def _shard_links(radius: int):
    def shard(fps: list[int], reps: list[int], own: list[bool], out: list) -> None:
        """Links of one shard: its tree's members come first."""
        tree, members = BKTree(radius), []
        for fp, rep, is_own in zip(fps, reps, own):
            key = fp & 0xFFFFFFFFFFFFFFFF
            if is_own:
                tree.add(key)
                members.append(rep)
            else:
                out.extend((rep, members[r]) for r in {tree.find(h) for h in tree.near(key)})
        out.extend((rep, members[tree.find(i)]) for i, rep in enumerate(members) if tree.find(i) != i)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; the last shard of a batch may go on."""
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            ids = [pdf[c].to_numpy() for c in ("t", "key", "salt", "asks")]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in ids])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = pdf.iloc[last:]
            yield links(pdf.iloc[:last], np.concatenate(([0], cuts)) if len(cuts) else cuts)
        if held is not None:
            yield links(held, np.array([0, len(held)]))

    def links(pdf: pd.DataFrame, cuts) -> pd.DataFrame:
        fps, reps, own = pdf["fp"].tolist(), pdf["rep"].tolist(), pdf["own"].tolist()
        out: list = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            shard(fps[a:b], reps[a:b], own[a:b], out)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``nodes`` (fp, rep), one row per fingerprint -> links (a, b) between
    representatives that join all fingerprints within the radius."""
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for t, m in enumerate(block_masks(radius + 2))
    ])
    rows = nodes.select("fp", "rep", F.explode(tables).alias("b")).select("fp", "rep", "b.t", "b.key")
    full = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = rows.join(full, ["t", "key"]).withColumn("parts", F.ceil(F.col("m") / shard).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # a pair of parts is a shard of its own: the earlier part's tree, queried by the later part
    dealt = met.select("t", "key", "fp", "rep", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("t", "key", F.least("part", "other").alias("salt"), F.greatest("part", "other").alias("asks"), "fp", "rep",
                         (F.col("part") <= F.col("other")).alias("own"))
    return (dealt.repartition("t", "key", "salt", "asks")
            .sortWithinPartitions("t", "key", "salt", "asks", F.desc("own"), "fp")
            .mapInPandas(_shard_links(radius), "a long, b long").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id."""
    found = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = found.groupBy("fp").agg(F.min("id").alias("least"))
    # fingerprints link by themselves, so rows without an id connect others too
    parts = connected_components(near_links(nodes.select("fp", F.col("fp").alias("rep")), radius, shard))
    named = nodes.join(parts, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("g_fp"), "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    groups = named.join(least, F.col("component") == F.col("c")).select("g_fp", "component_id")
    return found.join(groups, F.col("fp") == F.col("g_fp")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their component, one per component
    (of rows that repeat that id, one); all columns. Rows without an id can't
    be named, so all of them stay."""
    groups = near_groups(docs, id_col, text_col, **options)
    first = groups.where(F.col(id_col) == F.col("component_id")).select(F.col("component_id").alias("k")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).cast("long").alias("id"))
    met = rows.join(first, F.col("id") == F.col("k"), "left_semi")
    one = Window.partitionBy("id").orderBy(F.length(F.col("row")[text_col]).desc())
    kept = met.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


@register("op2_simhash_bk")
def op2_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    return near_groups(table(spark, sf_dir, "documents"))
