"""Source divergence audit: which sources of a language use its words unlike
each other, and which words set a source apart.

Duplicate-text collapse: rows with one (lang, SHA-256 of the text) are one
text, with its number of rows per source. The text travels once per map task
and source (equal rows combine map-side), only the least source of a text
brings it to the tokenizer, and the multiplicities, which are slim, meet it
there. A text is tokenized once; its counts and document frequencies are
weighted by the multiplicities and added up in the worker before the shuffle.

Terms: runs of letters A-Z, a-z and characters from U+0080 up, A-Z lowered. A
language keeps the terms of at least ``min_docs`` of its rows. With V kept
terms and N occurrences of them in a group, a term with ``count`` occurrences
has p = 1 + floor(10**9 * (count + 1) / (N + V)), and p against q scores
f = floor((p - q)**2 / q). All arithmetic is on integers.

Pairs of sources are evaluated sparsely: a term that neither source holds
scores the same for every such term, and a term that one of them holds depends
on one count only. So every group brings a histogram of its p, and terms that
two sources share bring the difference, summed in the worker in blocks of
sources. No pair of sources ever meets a term that neither holds.

Cases: null text, lang and source are read as ''; a group without terms has
counts of zero; a language without kept terms has pairs of value 0 and no term
rows; repeated rows count each; equal values rank by UTF-8 order of the item; a
very long text is tokenized in a stream; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import checkpointed, register, table, text_or_empty

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Terms of texts that a worker holds before it adds them up and sends them on.
HELD = 2_000_000
#: Sources per side of a block of pair sums, and blocks held at a time (0.5 MB each).
BLOCK = 256
BLOCKS = 128
#: Pairs of sources evaluated at a time.
PAIRS = 1_000_000
#: Texts above it are tokenized in a stream.
LONG_TEXT = 1 << 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: bytes) -> Counter:
    """Term counts of a UTF-8 text: bytes from 0x80 up are the characters from
    U+0080 up, and ``bytes.lower`` lowers A-Z only."""
    low = text.lower()
    return Counter(_TERM.findall(low) if len(low) <= LONG_TEXT else (m[0] for m in _TERM.finditer(low)))


def collapsed(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """One row per distinct (lang, text): lang, text, sources (source, n)."""
    key = ["lang", "sha", "source"]
    text = text_or_empty(docs[text_col])
    rows = docs.select(text_or_empty(docs[lang_col]).alias("lang"), text_or_empty(docs[source_col]).alias("source"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))
    texts = rows.groupBy(*key).agg(F.min("text").alias("text"))
    many = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "sha") \
        .agg(F.min("source").alias("source"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return texts.join(many, key).select("lang", F.col("text").cast("binary").alias("text"), "sources")


_COUNTS = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]))


class _Counts:
    """Terms of one language's texts: term, source, occurrences, rows."""

    def __init__(self):
        self.terms, self.sources = defaultdict(count().__next__), defaultdict(count().__next__)
        self.term, self.n, self.many, self.of, self.copies = [], [], [], [], []

    def add(self, found: Counter, sources: list) -> None:
        ids, times = list(map(self.terms.__getitem__, found)), list(found.values())
        for s in sources:
            self.term += ids
            self.n += times
            self.many.append(len(ids))
            self.of.append(self.sources[s["source"]])
            self.copies.append(s["n"])

    def out(self, lang: str) -> pa.RecordBatch:
        """One row per term, its sums by source as a list."""
        many = np.array(self.many, np.int64)
        copies = np.repeat(np.array(self.copies, np.int64), many)
        key = np.array(self.term, np.int64) * len(self.sources) + np.repeat(np.array(self.of, np.int64), many)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        n, docs = (np.add.reduceat(x[order], starts) if len(starts) else x for x in (np.array(self.n, np.int64) * copies, copies))
        key = key[order][starts]
        of_term = key // max(1, len(self.sources))
        first = np.flatnonzero(np.diff(of_term, prepend=-1))
        names = pa.array(list(self.sources), pa.string()).take(pa.array(key % max(1, len(self.sources))))
        by = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)),
                                      pa.StructArray.from_arrays([names, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], fields=list(_COUNTS.value_type)))
        found = pa.array(list(self.terms), pa.binary()).take(pa.array(of_term[first]))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), found, by], names=["lang", "term", "by"])


def _counting(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Counts] = defaultdict(_Counts)
        size = 0
        for batch in batches:
            for lang, text, sources in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "sources"))):
                found = terms(text)
                held[lang].add(found, sources)
                size += len(found) * len(sources)
                if size > most:
                    yield from (c.out(x) for x, c in held.items())
                    held.clear()
                    size = 0
        yield from (c.out(x) for x, c in held.items())

    return run


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD) -> DataFrame:
    """lang, term, source, n (occurrences), docs (rows that hold the term).
    One shuffle, by term: the workers' lists meet there."""
    counted = collapsed(docs, lang_col, source_col, text_col).mapInArrow(
        _counting(held), "lang string, term binary, by array<struct<source:string,n:bigint,docs:bigint>>")
    met = counted.select("lang", F.col("term").cast("string").alias("term"), "by").repartition("lang", "term")
    return met.select("lang", "term", F.inline("by")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a count, exact; null without kept terms."""
    up = (n.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    over = total.cast("decimal(19,0)") + kept.cast("decimal(19,0)")
    return F.when(kept > 0, F.call_function("div", up, over) + F.lit(1))


def score(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p, q):
    return (p - q) ** 2 // q


def _pairs(lens: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) entry numbers of all pairs of entries within each list,
    about ``most`` at a time. ``lens``: entries per list."""
    size = np.repeat(lens, lens)  # per entry: pairs that start with it
    start = np.repeat(np.cumsum(lens) - lens, lens)
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        k = size[a:b]
        left = np.repeat(np.arange(a, b), k)
        yield left, np.repeat(start[a:b], k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        a = b


def _sharing(size: int, most: int, pairs: int):
    """Per pair of sources, summed over the terms that both hold: their score
    less what the histograms and the base count for such a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            by, coded = batch.column("by"), batch.column("lang").dictionary_encode()
            langs = coded.dictionary.to_pylist()
            lens = by.value_lengths().to_numpy()
            lang = np.repeat(coded.indices.to_numpy(), lens)
            at, p, p0 = (by.flatten().field(k).to_numpy() for k in ("at", "p", "p0"))
            wide = int(at.max()) // size + 1
            for x, y in _pairs(lens, pairs):
                pg, og, ps, os = p[x], p0[x], p[y], p0[y]
                value = _f(pg, ps) - _f(pg, os) - _f(og, ps) + _f(og, os)
                where = (lang[x].astype(np.int64) * wide + at[x] // size) * wide + at[y] // size
                cell = at[x] % size * size + at[y] % size
                for w in np.unique(where):
                    key = (langs[w // (wide * wide)], int(w // wide % wide), int(w % wide))
                    if key not in held:
                        if len(held) >= most:
                            yield out(held)
                            held = {}
                        held[key] = np.zeros(size * size, np.int64)
                    mine = where == w
                    np.add.at(held[key], cell[mine], value[mine])
        yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for (lang, i, j), block in held.items():
            found = np.flatnonzero(block)
            for col, more in zip(cols, ([lang] * len(found), found // size + i * size, found % size + j * size, block[found])):
                col.extend(more)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["lang", "g", "s", "value"])

    return run


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP_TERMS, held: int = HELD, block: int = BLOCK, blocks: int = BLOCKS,
               pairs: int = PAIRS) -> DataFrame:
    """lang, source, part, item, value, rank. ``pair``: every other source of
    the language by the score summed over all kept terms; ``term``: the
    ``top`` terms that the source uses more than its language."""
    kept = checkpointed(term_counts(docs, lang_col, source_col, text_col, held).groupBy("lang", "term")
                        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
                        .where(F.col("docs") >= min_docs).select("lang", "term", "total", "by"))
    groups = checkpointed(_groups(docs, kept, lang_col, source_col))
    rows = kept.select("lang", "term", "total", F.explode("by").alias("b")).select("lang", "term", "total", "b.source", "b.n")
    met = rows.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("all_n"), F.col("kept")))
    return _term_part(met, top).unionByName(_pair_part(met, groups, (block, blocks, pairs)))


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row per (lang, source) that occurs: at (number within the
    language), all_n (N), held (kept terms that occur), p0 (p of a term that
    does not), kept (V) and lang_n (N of the language)."""
    names = docs.select(text_or_empty(docs[lang_col]).alias("lang"), text_or_empty(docs[source_col]).alias("source")).distinct()
    sums = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", "b.source").agg(F.sum("b.n").alias("all_n"), F.count(F.lit(1)).alias("held"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    number = Window.partitionBy("lang").orderBy("source")
    return names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["all_n", "held", "kept", "lang_n"]) \
        .withColumn("p0", share(F.lit(0), F.col("all_n"), F.col("kept"))) \
        .withColumn("at", (F.row_number().over(number) - 1).cast("long"))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(first))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _term_part(met: DataFrame, top: int) -> DataFrame:
    against = met.withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("kept"))).where("p > q")
    return _ranked(against.select("lang", "source", F.col("term").alias("item"), score(F.col("p"), F.col("q")).alias("value")), "term", top)


def _pair_part(met: DataFrame, groups: DataFrame, bounds: tuple[int, int, int]) -> DataFrame:
    shared = met.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "p0")).alias("by")).where(F.size("by") > 1) \
        .select("lang", "by").mapInArrow(_sharing(*bounds), "lang string, g long, s long, value long").where("g <> s")
    hist = met.groupBy("lang", "at", "p").agg(F.count(F.lit(1)).alias("h")).groupBy("lang", "at") \
        .agg(F.collect_list(F.struct("p", "h")).alias("hist"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("at", "p0", "held")).alias("others"))
    pairs = groups.join(hist, ["lang", "at"], "left").join(others, "lang").withColumn("o", F.explode("others")).where("o.at <> at")

    def over_hist(f) -> Column:
        none = F.array().cast("array<struct<p:bigint,h:bigint>>")
        return F.aggregate(F.coalesce("hist", none), F.lit(0).cast("long"), lambda acc, x: acc + x["h"] * f(x["p"]))

    o = F.col("o")
    base = F.coalesce((F.col("kept") - F.col("held") - o["held"]) * score(F.col("p0"), o["p0"]), F.lit(0).cast("long"))
    each = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("at").alias("g"), o["at"].alias("s"), (over_hist(lambda p: score(p, o["p0"])) + base).alias("value")),
        F.struct(o["at"].alias("g"), F.col("at").alias("s"), over_hist(lambda p: score(o["p0"], p)).alias("value")))).alias("x")).select("lang", "x.*")
    total = each.unionByName(shared).groupBy("lang", "g", "s").agg(F.sum("value").alias("value"))
    g = groups.select("lang", F.col("at").alias("g"), "source")
    s = groups.select("lang", F.col("at").alias("s"), F.col("source").alias("item"))
    return _ranked(total.join(g, ["lang", "g"]).join(s, ["lang", "s"]), "pair")


def _oracle() -> str:
    """The definition in DuckDB SQL."""
    p = "CAST(1 + ({s} * (CAST({n} AS HUGEINT) + 1)) // ({total} + v) AS HUGEINT)"
    of = lambda n, total: p.format(s=SCALE, n=n, total=total)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, '{letters}', '{letters.lower()}')) AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS gn, sum(n) OVER (PARTITION BY lang) AS ln,
    sum(n) OVER (PARTITION BY lang, term) AS tn FROM c JOIN v USING (lang)),
q AS (SELECT lang, source, term, n, {of('n', 'gn')} AS p, {of('tn', 'ln')} AS q FROM s),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM q a JOIN q b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
one AS (SELECT lang, source, 'pair' AS part, item, value FROM every
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM q WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM one)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""


ORACLE = _oracle()


@register("op12_source_divergence", ORACLE)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diverging sources and terms of every language of ``documents``."""
    return divergence(table(spark, sf_dir, "documents"))
