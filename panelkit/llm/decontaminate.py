"""Benchmark decontamination on typed templates. DataFrame functions only.

Template: the words of a text (runs of letters and digits, lower case) with
numbers, names and units replaced by ``<num>``, ``<name>``, ``<unit>``. A word
is a number if it starts with a digit, a unit if it is one of ``UNITS``, a
name if it starts with a capital and follows a letter, digit, comma,
semicolon or bracket and one white-space character (so not at the start of a
sentence).

Windows: every ``window`` consecutive template words, as one 64-bit hash. Windows of all documents meet the benchmark's
windows in a hash join. The benchmark side is broadcast only while it has
at most ``BROADCAST_WINDOWS`` windows (counted first); beyond that both sides are
shuffled. An item shorter than the window is one window of its own length. A window of
fewer than ``MIN_FIXED`` words beside its placeholders says little and is left out;
where names as plain words leave it so too (numbers, units, very short items), it matches
the item's own words, not other fillings: an item "42" is found where a text holds 42.
Benchmark items stand in three variants, so that a copy still matches after
lower-casing or inside another sentence: as written, names as plain words, and
the first word as a name. In a fourth variant, of items and of documents, every
word with a capital is a name, also one that opens a sentence or follows a
quote, a bracket or several white-space characters. It finds (document, item)
pairs that the others miss; pairs that they report keep their figures. A
document adds the windows that hold such a word, not all windows again.

Slots: matched windows of a document and an item form alignments (position in
the text minus position in the item), over all variants. In an alignment the words that fill the
item's placeholders must agree: equal words of a type stand for equal words
(different words may stand for equal ones, as new values can coincide). Where
they disagree, windows that hold a disagreeing slot, or another changed slot of
that type, are taken out; windows without placeholders, with unchanged slots
or of another type stay. What remains must cover ``min_coverage`` of the item's
windows. ``n_changed`` counts re-parameterised slots.

Cases: null and empty texts and items match nothing; long texts are explored
whole; rows that share an id are aligned by text, then reported once per id and
item; rows with a null id are reported under null; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import checkpointed, register, table, text_or_empty

WINDOW = 5
MIN_COVERAGE = 0.5
BROADCAST_WINDOWS = 1_000_000
#: Rows of (id, text hash) or ids up to which a semi or anti join is broadcast (counted first).
BROADCAST_ROWS = 1_000_000
#: Words beside placeholders from which a window matches other fillings.
MIN_FIXED = 2
#: Numbers of the variants with names as plain words and with every capital as a name.
PLAIN, CAPITALS = 1, 3
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg",
         "gram", "grams", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon",
         "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
         "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees",
         "meter", "meters", "metre", "metres", "mph", "kmh", "kw", "kwh", "volt", "volts", "watt", "watts")
MARK = "\x01"
#: Begins a word with a capital that is no name: the fourth variant makes it one.
OPENS = "\x02"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;)][\x20\x09-\x0D]\p{Lu})"


_OPENS = r"(?<![\p{L}\p{N}\x01])\p{Lu}"


def words(text: Column, names: bool = True, opens: bool = False) -> Column:
    """Lower-cased words; a name begins with ``MARK``, with ``opens`` any
    other word with a capital with ``OPENS``."""
    clean = F.regexp_replace(text_or_empty(text), MARK, " ")
    marked = F.regexp_replace(clean, _NAME, MARK + "$0") if names else clean
    if opens:
        marked = F.regexp_replace(F.replace(marked, F.lit(OPENS), F.lit(".")), _OPENS, OPENS + "$0")
    return F.array_remove(F.split(F.lower(marked), r"[^\p{L}\p{N}\x01\x02]+" if opens else r"[^\p{L}\p{N}\x01]+"), "")


def _bare(word: Column) -> Column:
    return F.translate(word, MARK + OPENS, "")


def slot_type(word: Column, plain: Column | None = None) -> Column:
    """Placeholder of a word, ``plain`` (else null) for one without. Words
    are made of letters, digits and ``MARK``, so those below ":" begin with a
    digit or the mark: one comparison for most words."""
    special = F.when(word < "0", "<name>").otherwise("<num>")
    out = F.when(word < ":", special).when(word.isin(*UNITS), "<unit>")
    return out if plain is None else out.otherwise(plain)


def word_hashes(found: Column) -> Column:
    """Hash of every word's template; a word that begins with ``OPENS`` as the
    plain word."""
    def one(w: Column) -> Column:
        bare = F.translate(w, OPENS, "")
        plain = F.when(w.isin(*UNITS), "<unit>").otherwise(w)
        early = F.when(w < OPENS, "<name>").when(w < "\x03", F.when(bare.isin(*UNITS), "<unit>").otherwise(bare)).otherwise("<num>")
        return F.xxhash64(F.when(w < ":", early).otherwise(plain))

    return F.transform(found, one)


def window_hashes(h: Column, size: int) -> Column:
    """Hashes of all ``size``-word windows of the array column ``h``."""
    n = F.greatest(F.size(h) - (size - 1), F.lit(0))
    return F.transform(F.slice(h, F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))


def benchmark_tables(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(windows: item_id, variant, start, wh, n_windows, size, own; slots: item_id,
    variant, at, value) of every item and variant."""
    base = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    typed, plain = words(F.col("text")), words(F.col("text"), names=False)
    first = F.concat(F.array(F.concat(F.lit(MARK), F.element_at(typed, 1))), F.slice(typed, F.lit(2), F.size(typed)))
    capital = F.transform(words(F.col("text"), opens=True), lambda w: F.translate(w, OPENS, MARK))
    variants = base.select("item_id", F.explode(F.array(
        F.struct(F.lit(0).alias("variant"), typed.alias("w")), F.struct(F.lit(1).alias("variant"), plain.alias("w")),
        F.struct(F.lit(2).alias("variant"), F.when(F.size(typed) > 0, first).otherwise(typed).alias("w")),
        F.struct(F.lit(CAPITALS).alias("variant"), F.when((capital != typed) & (capital != first), capital).alias("w")))).alias("v")) \
        .select("item_id", "v.*").where(F.size("w") > 0)
    # words beside placeholders up to every position, for the count in a window
    fixed = F.transform("w", lambda w: F.when(slot_type(w).isNull(), 1).otherwise(0))
    hashed = variants.withColumns({"h": word_hashes(F.col("w")), "e": F.transform("w", lambda w: F.xxhash64(_bare(w))), "f": fixed})
    parts = []
    for size in range(1, window + 1):
        part = hashed.where(F.size("h") >= window if size == window else F.size("h") == size)
        both = part.withColumns({"win": window_hashes(F.col("h"), size), "own": window_hashes(F.col("e"), size)})
        rows = both.select("item_id", "variant", "f", F.size("win").alias("n_windows"), F.posexplode(F.arrays_zip("win", "own")).alias("start", "x"))
        count = F.aggregate(F.slice("f", F.col("start") + 1, size), F.lit(0), lambda acc, x: acc + x)
        part = rows.select("item_id", "variant", "start", F.when(count >= MIN_FIXED, F.col("x.win")).otherwise(F.col("x.own")).alias("wh"),
                           "n_windows", F.lit(size).alias("size"), (count < MIN_FIXED).alias("own"))
        parts.append(part.where(~F.col("own") | (F.col("variant") == PLAIN)))
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.union(part)
    slots = variants.select("item_id", "variant", F.posexplode("w").alias("at", "value")) \
        .where(slot_type(F.col("value")).isNotNull())
    return windows, slots


def _row(text: Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def window_hits(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """doc_id, row, pos, item_id, variant, start, n_windows, size of every
    document window that is a benchmark window; ``capitals``: only with every
    capital as a name."""
    counted = {(r["size"], r["own"]): r["n"] for r in windows.groupBy("size", "own").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = docs.select("doc_id", _row(F.col("text")).alias("row"), words(F.col("text"), opens=True).alias("w"))
    opening = F.filter(F.transform("w", lambda w, i: F.when(w.startswith(OPENS), i)), lambda i: i.isNotNull())
    hashed = base.withColumns({"h": word_hashes(F.col("w")), "o": opening})
    named = F.zip_with("w", "h", lambda w, h: F.when(w.startswith(OPENS), F.xxhash64(F.lit("<name>"))).otherwise(h))
    hashed = hashed.withColumn("c", F.when(F.size("o") > 0, named))
    hits = None
    for (size, own), n in sorted(counted.items()):
        if own:  # the words themselves
            rows = base.select("doc_id", "row", F.transform("w", lambda w: F.xxhash64(_bare(w))).alias("e")) \
                .select("doc_id", "row", F.posexplode(window_hashes(F.col("e"), size)).alias("pos", "wh")).withColumn("capitals", F.lit(False))
        else:
            rows = _typed_windows(hashed, size)
        side = windows.where((F.col("size") == size) & (F.col("own") == own)).drop("own")
        side = F.broadcast(side) if n <= BROADCAST_WINDOWS else side
        met = rows.join(side, "wh").drop("wh").withColumn("capitals", F.col("capitals") | (F.col("variant") == CAPITALS))
        hits = met if hits is None else hits.unionByName(met)
    return hits


def _typed_windows(hashed: DataFrame, size: int) -> DataFrame:
    """doc_id, row, pos, wh, capitals: all windows as written, then those that
    a word makes different whose capital opens a sentence."""
    last = F.size("h") - size
    near = F.transform("o", lambda p: F.sequence(F.greatest(p - (size - 1), F.lit(0)), F.least(p, last)))
    starts = F.when((F.size("o") > 0) & (last >= 0), F.array_distinct(F.flatten(near))).otherwise(F.array().cast("array<int>"))
    both = hashed.withColumn("win", window_hashes(F.col("h"), size)).withColumn("at", starts)
    more = F.transform("at", lambda i: F.xxhash64(*[F.get(F.col("c"), i + k) for k in range(size)]))
    # outer: else Spark infers a filter that computes the whole array a second time
    rows = both.select("doc_id", "row", "at", F.size("win").alias("n"), F.posexplode_outer(F.concat("win", more)).alias("pos", "wh"))
    again = F.col("pos") >= F.col("n")
    return rows.select("doc_id", "row", "wh", again.alias("capitals"), F.when(again, F.get("at", F.col("pos") - F.col("n"))).otherwise(F.col("pos")).alias("pos"))


ALIGNMENT = ["doc_id", "row", "item_id", "offset"]


def _slots_of(hits: DataFrame) -> DataFrame:
    """Item positions of the windows of every alignment and variant."""
    return hits.select(*ALIGNMENT, "variant", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at")).distinct()


def consistent(docs: DataFrame, hits: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits without the windows whose slots disagree, slot pairs of the rest)."""
    pairs = checkpointed(_slots_of(hits).join(slots, ["item_id", "variant", "at"]))
    wanted = _side(pairs.select(F.col("doc_id").alias("p_id"), F.col("row").alias("p_row")).distinct())
    found = docs.select("doc_id", _row(F.col("text")).alias("row"), "text") \
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("row") == F.col("p_row")), "left_semi") \
        .dropDuplicates(["doc_id", "row"]) \
        .select(F.col("doc_id").alias("d_id"), F.col("row").alias("d_row"), F.posexplode(words(F.col("text"), opens=True)).alias("d_pos", "filled")) \
        .where(slot_type(F.col("filled")).isNotNull())  # a placeholder is only ever matched by one of its kind
    met = pairs.join(found, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row") == F.col("d_row"))
                     & (F.col("at") + F.col("offset") == F.col("d_pos")))
    bare = [_bare(F.col(c)).alias(c) for c in ("value", "filled")]
    pairs = checkpointed(met.select(*ALIGNMENT, "variant", "at", slot_type(F.col("value")).alias("kind"), *bare))
    differ = pairs.groupBy(*ALIGNMENT, "kind", "value").agg(F.count_distinct("filled").alias("n")).where("n > 1")
    if differ.isEmpty():
        return hits, pairs
    differ = checkpointed(differ)
    out = _matching(pairs, differ, [*ALIGNMENT, "kind", "value"], "left_semi").union(
        _matching(pairs.where("value <> filled"), differ, [*ALIGNMENT, "kind"], "left_semi"))
    touched = out.select(*ALIGNMENT, "variant", F.col("at").alias("o_at"))
    b = touched.select(*[F.col(k).alias(f"b_{k}") for k in touched.columns]).distinct()
    same = (F.col("b_o_at") >= F.col("start")) & (F.col("b_o_at") < F.col("start") + F.col("size"))
    for k in [*ALIGNMENT, "variant"]:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    rest = checkpointed(hits.join(b, same, "left_anti"))
    return rest, _matching(pairs, _slots_of(rest), [*ALIGNMENT, "variant", "at"], "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per (document, item) that leaked: id, item_id, n_windows,
    n_covered, coverage, n_slots, n_changed."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows, slots = benchmark_tables(items, item_col, item_text, window)
    hits = window_hits(slim, windows, window)
    empty = "doc_id long, item_id long, n_windows long, n_covered long, coverage double, n_slots long, n_changed long"
    if hits is None:
        return docs.sparkSession.createDataFrame([], empty).withColumnRenamed("doc_id", id_col)
    hits = checkpointed(hits.withColumn("offset", F.col("pos") - F.col("start")))
    whole = hits.groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("start").alias("n"))
    likely = whole.where(F.col("n") >= min_coverage * F.col("n_windows"))
    pair = ["doc_id", "item_id"]
    hits = _matching(hits, likely, pair, "left_semi")
    found = _reported(slim, hits.where("NOT capitals"), slots, min_coverage)
    if not hits.where("capitals").isEmpty():
        found = checkpointed(found)
        more = _matching(_matching(hits, hits.where("capitals"), pair, "left_semi"), found, pair, "left_anti")
        more = checkpointed(more)
        if not more.isEmpty():
            found = found.union(_reported(slim, more, slots, min_coverage))
    return found.withColumnRenamed("doc_id", id_col)


def _reported(docs: DataFrame, hits: DataFrame, slots: DataFrame, min_coverage: float) -> DataFrame:
    """The result rows of these hits."""
    changed = None
    # without a placeholder in any matched item there is nothing that could disagree
    if not hits.join(_side(slots.select("item_id", "variant").distinct()), ["item_id", "variant"], "left_semi").isEmpty():
        hits, pairs = consistent(docs, hits, slots)
        changed = pairs.groupBy("doc_id", "item_id").agg(
            F.count_distinct("value").alias("n_slots"),
            F.count_distinct(F.when(F.col("value") != F.col("filled"), F.col("value"))).alias("n_changed")
        ).select(F.col("doc_id").alias("c_id"), F.col("item_id").alias("c_item"), "n_slots", "n_changed")
    rest = hits.groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("start").alias("n_covered")) \
        .where(F.col("n_covered") >= min_coverage * F.col("n_windows"))
    if changed is None:
        rest = rest.withColumns({"n_slots": F.lit(0), "n_changed": F.lit(0)})
    else:
        rest = rest.join(changed, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("item_id") == F.col("c_item")), "left")
    return rest.select(
        "doc_id", "item_id", F.col("n_windows").cast("long"), F.col("n_covered").cast("long"),
        (F.col("n_covered") / F.col("n_windows")).alias("coverage"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
        F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))


def _side(keys: DataFrame) -> DataFrame:
    """A side of a semi or anti join: sent to every task while it is small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _matching(rows: DataFrame, others: DataFrame, key: list[str], how: str) -> DataFrame:
    """Semi or anti join on ``key``; ids may be null."""
    b = others.select(*[F.col(k).alias(f"b_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k).eqNullSafe(F.col(f"b_{k}")) if k == "doc_id" else F.col(k) == F.col(f"b_{k}"))
    return rows.join(b, same, how)


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id holds no benchmark item; all columns."""
    leaked = _side(checkpointed(contaminated(docs, items, id_col, text_col, **options).select(F.col(id_col).alias("k")).distinct()))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).cast("long").alias("id"))
    return rows.join(leaked, F.col("id").eqNullSafe(F.col("k")), "left_anti").select("row.*")


def _oracle() -> str:
    """The definition in DuckDB SQL, on window strings instead of hashes (for
    tables whose doc_id is unique)."""
    def split(text: str) -> str:
        return "list_filter(string_split_regex(lower(" + text + r"), '[^\p{L}\p{N}\x01\x02]+'), lambda x: x <> '')"

    def mark(text: str) -> str:
        return "regexp_replace(" + text + r", '([\p{L}\p{N},;)][\x20\x09-\x0D])(\p{Lu})', '\1' || chr(1) || '\2', 'g')"

    clean = "replace(coalesce(text, ''), chr(1), ' ')"
    # a one-letter name takes the letter before the next name; the second pass marks that one
    marked = mark(mark(clean))
    opened = "regexp_replace(replace(" + marked + r", chr(2), '.'), '(^|[^\p{L}\p{N}\x01])(\p{Lu})', '\1' || chr(2) || '\2', 'g')"
    units = ", ".join(f"'{u}'" for u in UNITS)
    kind = f"CASE WHEN x < '0' THEN '<name>' WHEN x < ':' THEN '<num>' WHEN x IN ({units}) THEN '<unit>' ELSE x END"
    bare = "replace(replace({}, chr(1), ''), chr(2), '')"
    plain = f"CASE WHEN x[1] = chr(2) THEN CASE WHEN {bare.format('x')} IN ({units}) THEN '<unit>' ELSE {bare.format('x')} END ELSE {kind} END"

    def reported(n: str, hits: str) -> str:
        """CTEs that end in ``{n}_ok`` and ``{n}_ch``, the figures of these hits."""
        where = "doc_id, item_id, off"
        slots = f"SELECT DISTINCT {where}, variant, unnest(range(start, start + size)) AS i FROM"
        return f"""
{n}_pr AS (SELECT DISTINCT {where}, variant, i, s.kind, s.value, {bare.format('w[i + off]')} AS filled
       FROM ({slots} {hits}) JOIN sl s USING (item_id, variant, i) JOIN d USING (doc_id) WHERE w[i + off] < ':' OR w[i + off] IN ({units})),
{n}_di AS (SELECT {where}, kind, value FROM {n}_pr GROUP BY ALL HAVING count(DISTINCT filled) > 1),
{n}_out AS (SELECT DISTINCT {where}, variant, i FROM {n}_pr SEMI JOIN {n}_di USING ({where}, kind, value)
       UNION SELECT {where}, variant, i FROM {n}_pr SEMI JOIN {n}_di USING ({where}, kind) WHERE value <> filled),
{n}_rest AS (SELECT * FROM {hits} h WHERE NOT EXISTS (SELECT 1 FROM {n}_out o WHERE o.doc_id = h.doc_id AND o.item_id = h.item_id
       AND o.off = h.off AND o.variant = h.variant AND o.i >= h.start AND o.i < h.start + h.size)),
{n}_ok AS (SELECT doc_id, item_id, n_windows, count(DISTINCT start) AS n_covered FROM {n}_rest
       GROUP BY 1, 2, 3 HAVING count(DISTINCT start) >= {MIN_COVERAGE} * n_windows),
{n}_ch AS (SELECT doc_id, item_id, count(DISTINCT value) AS n_slots, count(DISTINCT CASE WHEN value <> filled THEN value END) AS n_changed
       FROM {n}_pr SEMI JOIN ({slots} {n}_rest) USING ({where}, variant, i) GROUP BY 1, 2)"""

    keys = "array_to_string({0}[p:p + size - 1], ' ')"
    return f"""
WITH d AS (SELECT doc_id, {split(opened)} AS w FROM documents),
dt AS (SELECT doc_id, list_transform(w, lambda x: {plain}) AS t, list_transform(w, lambda x: CASE WHEN x[1] = chr(2) THEN '<name>' ELSE {kind} END) AS c,
       list_transform(w, lambda x: {bare.format('x')}) AS e FROM d),
typed AS (SELECT item_id, {split(marked)} AS w, {split(clean)} AS pl, list_transform({split(opened)}, lambda x: replace(x, chr(2), chr(1))) AS cap FROM benchmark),
named AS (SELECT *, CASE WHEN len(w) > 0 THEN list_concat([chr(1) || w[1]], w[2:]) ELSE w END AS first FROM typed),
iv AS (SELECT item_id, 0 AS variant, w FROM named UNION ALL SELECT item_id, 1, pl FROM named UNION ALL SELECT item_id, 2, first FROM named
       UNION ALL SELECT item_id, {CAPITALS}, cap FROM named WHERE cap <> w AND cap <> first),
it AS (SELECT item_id, variant, w, list_transform(w, lambda x: {kind}) AS t, list_transform(w, lambda x: {bare.format('x')}) AS e,
              least(len(w), {WINDOW}) AS size, len(w) - least(len(w), {WINDOW}) + 1 AS n_windows FROM iv WHERE len(w) > 0),
iw AS (SELECT item_id, variant, size, n_windows, p AS start, len(list_filter(t[p:p + size - 1], lambda x: x[1] <> '<')) < {MIN_FIXED} AS own,
              CASE WHEN own THEN {keys.format('e')} ELSE {keys.format('t')} END AS k
       FROM (SELECT *, unnest(range(1, n_windows + 1)) AS p FROM it) WHERE NOT own OR variant = {PLAIN}),
dw AS (SELECT doc_id, size, p, {keys.format('t')} AS k, {keys.format('c')} AS ck, {keys.format('e')} AS ek
       FROM (SELECT doc_id, t, c, e, size, unnest(range(1, len(t) - size + 2)) AS p FROM dt, (SELECT DISTINCT size FROM it) WHERE len(t) >= size)),
dk AS (SELECT doc_id, size, p, k, FALSE AS own, FALSE AS capitals FROM dw UNION ALL SELECT doc_id, size, p, ck, FALSE, TRUE FROM dw WHERE ck <> k
       UNION ALL SELECT doc_id, size, p, ek, TRUE, FALSE FROM dw),
h0 AS (SELECT doc_id, item_id, variant, start, size, n_windows, p - start AS off, capitals OR variant = {CAPITALS} AS capitals
       FROM dk JOIN iw USING (size, k, own)),
likely AS (SELECT DISTINCT doc_id, item_id FROM h0 GROUP BY doc_id, item_id, n_windows HAVING count(DISTINCT start) >= {MIN_COVERAGE} * n_windows),
h AS (SELECT * FROM h0 SEMI JOIN likely USING (doc_id, item_id)),
sl AS (SELECT item_id, variant, i, t[i] AS kind, {bare.format('w[i]')} AS value FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM it)
       WHERE t[i] IN ('<name>', '<num>', '<unit>')),
ha AS (SELECT * FROM h WHERE NOT capitals),{reported('a', 'ha')},
hb AS (SELECT * FROM h SEMI JOIN (SELECT DISTINCT doc_id, item_id FROM h WHERE capitals) USING (doc_id, item_id) ANTI JOIN a_ok USING (doc_id, item_id)),{reported('b', 'hb')}
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, n_covered, n_covered / n_windows AS coverage,
       coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed
FROM (SELECT * FROM a_ok LEFT JOIN a_ch USING (doc_id, item_id) UNION ALL SELECT * FROM b_ok LEFT JOIN b_ch USING (doc_id, item_id))"""


ORACLE = _oracle()


@register("op1_decontaminate", ORACLE)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked benchmark items of every row of ``documents``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
