"""Splits, sampling and resampling (survey H1-H6, C3, C8, F-6).

All randomness is the portable md5 uniform of (seed, key), so results do not
depend on partitioning or task retries. Exact row numbers use the
distributed prefix-sum numbering of :mod:`panelkit.operators.ranks`, never an
un-partitioned window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.random import portable_uniform
from panelkit.operators import ranks
from panelkit.session import materialize


#: Rows per group up to which Spark limits a window's groups before the shuffle
#: (the default of spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
#: Bootstrap draws generated from one row.
DRAW_BLOCK = 10_000


def random_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """H1: row-level split by threshold on the portable uniform (expected
    fraction ``test``); no shuffle."""
    u = portable_uniform(F.lit(seed), F.col(key))
    return df.withColumn(out, F.when(u < test, "test").otherwise("train"))


def group_split_table(df: DataFrame, group: str, test: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """H2/F2: whole groups; the first ``ceil(test * G)`` groups in hash order
    are test. Returns (group, split) - one row per group."""
    g = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn(
        "__u", portable_uniform(F.lit(seed), F.col(group)))
    numbered = ranks.row_number(g, ["__u", group], out="__rn")
    n_groups = g.agg(F.count(F.lit(1)).alias("__g"))
    return (numbered.crossJoin(F.broadcast(n_groups))
            .select(group, F.when(F.col("__rn") <= F.ceil(F.col("__g") * test), "test").otherwise("train").alias(out)))


def group_split(df: DataFrame, group: str, test: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """H2 + C3: tag every row with its group's split (join to the group table)."""
    return df.join(group_split_table(df, group, test, seed, out), group, "left")


def exact_split(df: DataFrame, key: str, fractions: Sequence[float] = (0.8, 0.1, 0.1),
                names: Sequence[str] = ("train", "valid", "test"), seed: int = 1337, out: str = "split") -> DataFrame:
    """Exact sizes after a seeded shuffle: ``int(f*N)`` for all but the
    last part, the remainder to the last."""
    u = df.withColumn("__u", portable_uniform(F.lit(seed), F.col(key)))
    numbered = ranks.row_number(u, ["__u", key], out="__rn")
    n = df.agg(F.count(F.lit(1)).alias("__N"))
    j = numbered.crossJoin(F.broadcast(n))
    cum = 0.0
    expr = None
    bounds = []
    for f in fractions[:-1]:
        bounds.append(f)
    edge = F.lit(0)
    for name, f in zip(names[:-1], bounds):
        edge = edge + F.floor(F.col("__N") * f)
        cond = F.col("__rn") <= edge
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        cum += f
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return j.withColumn(out, expr).drop("__u", "__rn", "__N")


def sample_n(df: DataFrame, n: int, key: str, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """H4/F-6: ``n`` rows without replacement (per ``by`` group when given),
    chosen by smallest portable uniform.

    Global form: ``orderBy(...).limit(n)`` (TakeOrderedAndProject, no full
    sort). Per group, up to ``GROUP_LIMIT`` rows: one top-n window, which Spark
    also applies before the shuffle, so a task sends at most ``n`` rows of a
    group. Larger samples: rows are first thinned to ``u < t_g`` with ``t_g`` set so
    that about ``n + 10 sqrt(n) + 10`` rows of each group survive (group sizes
    from one aggregate); groups left with fewer than ``min(n, size)``
    candidates fall back to all their rows. The top-n window then sorts a few
    hundred rows per group even when one group holds a third of the data,
    and the result is exactly the n smallest-u rows.
    """
    u = df.withColumn("__u", portable_uniform(F.lit(seed), F.col(key)))
    if not by:
        return u.orderBy("__u", key).limit(n).drop("__u")
    by = list(by)
    w = Window.partitionBy(*by).orderBy("__u", key)
    if n <= GROUP_LIMIT:
        known = u.where(F.concat(*[F.col(c).cast("string") for c in by]).isNotNull())  # a null group is no group
        return known.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__u", "__rn")
    sizes = u.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    want = float(n + 10 * n ** 0.5 + 10)
    j = u.join(sizes, by, "inner").withColumn("__t", F.least(F.lit(1.0), F.lit(want) / F.col("__size")))
    cand = j.where(F.col("__u") < F.col("__t"))
    got = cand.groupBy(*by).agg(F.count(F.lit(1)).alias("__got"))
    short = sizes.join(got, by, "left").where(
        F.coalesce(F.col("__got"), F.lit(0)) < F.least(F.lit(n), F.col("__size"))).select(*by)
    rest = j.where(F.col("__u") >= F.col("__t")).join(short, by, "left_semi")
    pool = cand.unionByName(rest)
    return (pool.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
            .drop("__u", "__rn", "__size", "__t"))


def poisson1_cdf(terms: int = 20) -> list[float]:
    """CDF of Poisson(1) at k = 0 .. terms - 1 (e^-1 * sum 1/j!)."""
    cdf, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(terms):
        acc += term
        cdf.append(acc)
        term /= k + 1
    return cdf


def bootstrap_weights(df: DataFrame, key: str, replicates: int, seed: int = 42, out: str = "w",
                      replicate_col: str = "b") -> DataFrame:
    """H5 (Poisson bootstrap): one row per (row, replicate) with a Poisson(1)
    weight from the portable uniform (inverse CDF; beyond k = 19 the tail is
    below the resolution of the uniform).

    Rows are never gathered: each replicate statistic is a weighted
    aggregate ``groupBy(cell, b)``. Rows with weight 0 are dropped.
    """
    # the uniforms are made before the rows are laid out: an expression beside the weights and their filter is hashed once for each use
    drawn = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda b: F.struct(
        b.alias(replicate_col), portable_uniform(F.lit(seed), b, F.col(key)).alias("__u")))
    reps, u = df.select("*", F.inline(drawn)), F.col("__u")
    cdf = poisson1_cdf()
    w = F.lit(len(cdf))
    for k in reversed(range(len(cdf))):
        w = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(w)
    return reps.withColumn(out, w).where(F.col(out) > 0).drop("__u")


def poisson_replicate_counts(counts: DataFrame, n: str, keys: Sequence[str], replicates: int, seed: int = 42,
                             replicate_col: str = "b", out: str = "w") -> DataFrame:
    """H5 on collapsed data: for rows already counted per distinct value
    combination (``keys`` with count ``n``), the Poisson(1) bootstrap weight
    total of the ``n`` identical rows in a replicate is one Poisson(``n``)
    draw - exactly the distribution of the row-level Poisson bootstrap.

    Work is (distinct combinations x replicates), independent of the row
    count; the draws use the portable uniform of (seed, replicate, keys).
    """
    reps = counts.select(*keys, n, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias(replicate_col))
    u = portable_uniform(F.lit(seed), F.col(replicate_col), *[F.col(k).cast("string") for k in keys])
    from panelkit.functions.tails import q_poisson

    return reps.withColumn(out, q_poisson(u, F.col(n)))


def bootstrap_draws(df: DataFrame, key: str, by: Sequence[str], replicates: int, seed: int = 42,
                    replicate_col: str = "b") -> DataFrame:
    """H5 exact n-of-n draws within each ``by`` stratum (C8 gather by index).

    Rows are numbered within their stratum, each replicate draws ``n``
    indices ``floor(u*n)+1`` and the draws are equi-joined back on
    (stratum, index). The draws of a stratum are laid out in blocks of
    ``DRAW_BLOCK`` that are dealt to tasks, so a hot stratum never sits in one
    array or one task. Output: one row per draw.
    """
    numbered = ranks.row_number(df, [key], out="__idx", by=by)  # bucketed: no whole-stratum sort
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    draws = (sizes.select(*by, "__n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias(replicate_col))
             .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / DRAW_BLOCK))).alias("__blk"))
             .repartition(replicate_col, "__blk", *by)
             .select(*by, "__n", replicate_col, F.explode(F.sequence(
                 F.col("__blk") * DRAW_BLOCK + 1, F.least((F.col("__blk") + 1) * DRAW_BLOCK, F.col("__n")))).alias("__draw")))
    keycols = [F.col(c).cast("string") for c in by]
    u = portable_uniform(F.lit(seed), F.col(replicate_col), F.col("__draw"), *keycols)
    draws = draws.withColumn("__idx", (F.floor(u * F.col("__n")) + 1).cast("long"))
    # the draws are few bytes before they are laid out: without the hint they pass for a table to broadcast
    return draws.hint("merge").join(numbered, list(by) + ["__idx"], "inner").drop("__idx", "__n", "__draw")


# ------------------------------------------------------------------ H6 keyed bijections
#: Modulus of the round function, the largest prime below 2^31: squares fit a long.
_PRIME = (1 << 31) - 1
ROUNDS = 4
#: Steps of a cycle walk that are unrolled; a walk is never longer than the root of the row count, and of more
#: than four steps with a probability below the fourth power of one over that root.
WALK = 64


def bijection_keys(seed: int, *parts) -> list[int]:
    """Three round keys per round, from md5 of (seed, parts, position)."""
    def key(i: int) -> int:
        text = ":".join(str(x) for x in (seed, *parts, i))
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % (_PRIME - 1) + 1

    return [key(i) for i in range(3 * ROUNDS)]


def _mixed(digit: Column, keys: Column, r: int) -> Column:
    """Keyed quadratic hash of a digit, below ``_PRIME``."""
    a, b, c = (F.element_at(keys, 3 * r + i + 1) for i in range(3))
    t = (a * (digit % _PRIME + 1) + b) % _PRIME
    return (t * t + c) % _PRIME


def _base(n: int) -> tuple[int, int]:
    """Mixed base (w, h) of 0..n-1: w * h >= n, fewer than w numbers in excess."""
    w = math.isqrt(max(n - 1, 0)) + 1
    return w, -(-n // w) or 1


def with_bijection(df: DataFrame, index: str, n: int, keys: str, out: str) -> DataFrame:
    """Add ``out``: a permutation of 0..n-1, computed from the index without
    sort or shuffle. The index is a pair of digits in the mixed base; rounds
    add a keyed quadratic hash of one digit to the other, which is a bijection
    of the pairs for any hash; a pair beyond n walks on along its cycle, which
    ends at a number below n. ``keys``: a column of :func:`bijection_keys`."""
    w, h = _base(n)
    k = F.col(keys)

    def once(x: Column) -> Column:
        """The same rounds as one expression, each round a lambda's argument."""
        state = F.array(F.struct(F.call_function("div", x, F.lit(w)).alias("h"), (x % w).alias("l")))
        for r in range(0, ROUNDS, 2):
            state = F.transform(state, lambda s: F.struct(((s["h"] + _mixed(s["l"], k, r)) % h).alias("h"), s["l"].alias("l")))  # noqa: B023
            state = F.transform(state, lambda s: F.struct(s["h"].alias("h"), ((s["l"] + _mixed(s["h"], k, r + 1)) % w).alias("l")))  # noqa: B023
        return state[0]["h"] * w + state[0]["l"]

    df = df.withColumns({"__h": F.call_function("div", F.col(index), F.lit(w)), "__l": F.col(index) % w})
    for r in range(0, ROUNDS, 2):
        df = df.withColumn("__h", (F.col("__h") + _mixed(F.col("__l"), k, r)) % h)
        df = df.withColumn("__l", (F.col("__l") + _mixed(F.col("__h"), k, r + 1)) % w)
    df = df.withColumn("__b", F.col("__h") * w + F.col("__l")).drop("__h", "__l")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("__b"), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    df = df.withColumn("__b", F.when(F.col("__b") < n, F.col("__b")).otherwise(walked))
    ended = F.when(F.col("__b") < n, F.col("__b")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))
    return df.withColumn(out, ended).drop(*[c for c in ["__b"] if c != out])


def bijection_sql(index: str, n: str, keys: str) -> str:
    """The DuckDB text of :func:`with_bijection`; ``keys`` is a list expression."""
    w = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    h = f"(({n} + {w} - 1) // {w})"

    def mixed(digit: str, r: int) -> str:
        t = f"((({keys})[{3 * r + 1}] * ({digit} % {_PRIME} + 1) + ({keys})[{3 * r + 2}]) % {_PRIME})"
        return f"(({t} * {t} + ({keys})[{3 * r + 3}]) % {_PRIME})"

    def once(x: str) -> str:
        state = f"[{x} // {w}, {x} % {w}]"
        for r in range(0, ROUNDS, 2):
            state = (f"list_transform([{state}], lambda s: [(s[1] + {mixed('s[2]', r)}) % {h}, s[2]])[1]")
            state = (f"list_transform([{state}], lambda s: [s[1], (s[2] + {mixed('s[1]', r + 1)}) % {w}])[1]")
        return f"list_transform([{state}], lambda s: s[1] * {w} + s[2])[1]"

    return (f"list_reduce(list_prepend({once(index)}, CAST(range({WALK}) AS BIGINT[])), "
            f"lambda x, i: CASE WHEN x < {n} THEN x ELSE {once('x')} END)")


def numbered_rows(df: DataFrame, key: str, out: str = "__i") -> DataFrame:
    """Rows with their 0-based identity rank, written once: everything after
    reads the numbered rows instead of the source."""
    src = materialize(df)
    return materialize(ranks.row_number(src, [key], out=out).withColumn(out, F.col(out) - 1))


def permutation_combos(spark, features: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """One row per (feature, repeat) with its round keys."""
    from panelkit.functions.common import literal_table

    return literal_table(spark, [(f, r, bijection_keys(seed, f, r)) for f in features for r in range(1, repeats + 1)],
                         ["feature", "repeat", "__keys"], ["string", "int", "array<bigint>"])


def permutation_map(df: DataFrame, key: str, features: Sequence[str], repeats: int, seed: int = 42) -> DataFrame:
    """H6: for each (feature, repeat), a permutation of the rows as a map
    (feature, repeat, key, source_key): the row with identity rank i receives
    the row with rank ``bijection(i)``. One numbering for all copies; the
    source rank is computed, not sorted, and met by one join."""
    base = numbered_rows(df.select(key), key)
    combos = permutation_combos(df.sparkSession, features, repeats, seed)  # features x repeats rows
    x = with_bijection(base.crossJoin(F.broadcast(combos)), "__i", base.count(), "__keys", "__i").select(key, "feature", "repeat", "__i")
    return x.join(base.withColumnRenamed(key, "source_key"), "__i").drop("__i")
