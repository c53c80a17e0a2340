"""Per-group equation fitting over a library of basis forms (survey M1-M8,
E6, F13).

Every (group, form, variant) fit is closed-form least squares from sums, so
the whole library is ONE wide grouped aggregate (sums of f, f^2, f*y for each
form, map-side combined) followed by an unpivot of the *aggregated* rows.
Variants: constant ``c`` (complexity 1), scaled ``f*c`` (cf + 2), affine
``f*c + c`` (cf + 4). Loss is the mean squared error.

Equations of several terms come from one Gram vector per group: a single read
of the rows adds up the products of all pairs of candidate terms, and the
sweep operator selects terms from the sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.basis import FORMS, Form
from panelkit.session import materialize


#: Columns that the fits return beside the keys; a key may not have one of these names.
OUTPUT = ("predictor", "form", "complexity", "variant", "a", "b", "loss", "n", "predictor2", "form2", "a2",
          "step", "predictors", "forms", "coefficients", "equation")


def _hidden_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Key columns under internal names, so that any key name (``k``, ``sf``,
    ...) is safe beside the sums."""
    clash = set(keys) & set(OUTPUT)
    if clash:
        raise ValueError(f"key columns named like result columns: {sorted(clash)}")
    hidden = [f"__key{i}" for i in range(len(keys))]
    return df.select("*", *[F.col(k).alias(h) for k, h in zip(keys, hidden)]), hidden


def _shown_keys(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    hidden = [f"__key{i}" for i in range(len(keys))]
    rest = [c for c in fits.columns if c not in hidden]
    return fits.select(*[F.col(h).alias(k) for k, h in zip(keys, hidden)], *rest)


def _base(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(f"__x{p}") for p, c in enumerate(xs)],
                     F.col(y).cast("double").alias("__y")).where(F.col("__y").isNotNull())


def _wide_sums(df: DataFrame, keys: list[str], xs: list[str], y: str, forms: Sequence[Form], min_rows: int) -> DataFrame:
    """One row per group: n, sum y, sum y^2 and per (predictor, form) the
    valid count, sum f, sum f^2, sum f*y (one map-side combined aggregate)."""
    fcols = [f.spark(F.col(f"__x{p}")).alias(f"__f{p}_{i}") for p in range(len(xs)) for i, f in enumerate(forms)]
    b = _base(df, keys, xs, y).select(*keys, "__y", *fcols)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("__y").alias("sy"), F.sum(F.col("__y") * F.col("__y")).alias("syy")]
    for p in range(len(xs)):
        for i in range(len(forms)):
            f = F.col(f"__f{p}_{i}")
            aggs += [F.count(f).alias(f"k{p}_{i}"), F.sum(f).alias(f"sf{p}_{i}"), F.sum(f * f).alias(f"sff{p}_{i}"),
                     F.sum(f * F.col("__y")).alias(f"sfy{p}_{i}")]
    return b.groupBy(*keys).agg(*aggs).where(F.col("n") >= min_rows)


def fit_equations(df: DataFrame, keys: Sequence[str], x: str | Sequence[str], y: str,
                  forms: Sequence[Form] = FORMS, min_rows: int = 3) -> DataFrame:
    """M1-M5: one row per (group, predictor, form, variant): complexity, a, b, loss.

    ``x`` may list several predictors (M5): every (predictor, form) pair is a
    candidate, still in the same single aggregate. Groups with fewer than
    ``min_rows`` rows are skipped (B5). A form is invalid for a group when f
    is null (outside its domain) on any row or has no spread.
    """
    df, hidden = _hidden_keys(df, keys)
    xs = [x] if isinstance(x, str) else list(x)
    return _shown_keys(_fit_equations(df, hidden, xs, y, forms, min_rows), list(keys))


def _fit_equations(df: DataFrame, keys: list[str], xs: list[str], y: str, forms: Sequence[Form],
                   min_rows: int) -> DataFrame:
    wide = _wide_sums(df, keys, xs, y, forms, min_rows)
    rows = F.array(*[F.struct(F.lit(xs[p]).alias("predictor"), F.lit(f.name).alias("form"),
                              F.lit(f.complexity).alias("cf"), F.col(f"k{p}_{i}").alias("k"),
                              F.col(f"sf{p}_{i}").alias("sf"), F.col(f"sff{p}_{i}").alias("sff"),
                              F.col(f"sfy{p}_{i}").alias("sfy"))
                     for p in range(len(xs)) for i, f in enumerate(forms)])
    long = wide.select(*keys, "n", "sy", "syy", F.inline(rows)).where(F.col("k") == F.col("n"))
    n = F.col("n")
    syy_c = F.col("syy") - F.col("sy") * F.col("sy") / n
    sff_c = F.col("sff") - F.col("sf") * F.col("sf") / n
    sfy_c = F.col("sfy") - F.col("sf") * F.col("sy") / n
    ok_aff = sff_c > F.lit(1e-9) * F.greatest(F.col("sff"), F.lit(1e-300))
    a_aff = sfy_c / sff_c
    affine = long.where(ok_aff).select(
        *keys, "predictor", "form", (F.col("cf") + 4).alias("complexity"), F.lit("affine").alias("variant"),
        a_aff.alias("a"), ((F.col("sy") - a_aff * F.col("sf")) / n).alias("b"),
        F.greatest((syy_c - a_aff * sfy_c) / n, F.lit(0.0)).alias("loss"), "n")
    ok_sc = F.col("sff") > 0
    a_sc = F.col("sfy") / F.col("sff")
    scaled = long.where(ok_sc).select(
        *keys, "predictor", "form", (F.col("cf") + 2).alias("complexity"), F.lit("scaled").alias("variant"),
        a_sc.alias("a"), F.lit(0.0).alias("b"),
        F.greatest((F.col("syy") - a_sc * F.col("sfy")) / n, F.lit(0.0)).alias("loss"), "n")
    const = wide.select(*keys, F.lit("").alias("predictor"), F.lit("const").alias("form"),
                        F.lit(1).alias("complexity"), F.lit("const").alias("variant"), F.lit(0.0).alias("a"),
                        (F.col("sy") / n).alias("b"), F.greatest(syy_c / n, F.lit(0.0)).alias("loss"), "n")
    return const.unionByName(scaled).unionByName(affine)


# ------------------------------------------------------------------ several terms from one Gram vector
#: Groups whose sums a task holds before it sends them on.
HELD_GROUPS = 2_000
#: Rows whose products are formed at a time.
ROWS_AT_ONCE = 1_000


class _Gram:
    """Sums of one group: n, sum y, sum y^2 and, over the m candidate terms,
    sum f, sum f y, valid count and the upper triangle of sum f f'."""

    def __init__(self, raw: bytes, n: int, m: int):
        v = np.frombuffer(raw)
        self.n, self.sy, self.syy = n, v[0], v[1]
        self.sf, self.sfy, count = v[2:2 + m], v[2 + m:2 + 2 * m], v[2 + 2 * m:2 + 3 * m]
        self.G = np.zeros((m, m))
        self.G[np.triu_indices(m)] = v[2 + 3 * m:]
        self.G += np.triu(self.G, 1).T
        self.valid = count == n
        self.yy = self.syy - self.sy * self.sy / n
        self.C = self.G - np.outer(self.sf, self.sf) / n
        self.cy = self.sfy - self.sf * self.sy / n
        self.spread = self.valid & (np.diag(self.C) > 1e-9 * np.maximum(np.diag(self.G), 1e-300))

    def loss(self, rss: float) -> float:
        return max(float(rss) / self.n, 0.0)

    def best(self, gain: np.ndarray, allowed: np.ndarray, order: Sequence[int]) -> int | None:
        """The allowed term with the largest gain; equal gains by ``order``."""
        ids = [j for j in order if allowed[j]]
        if not ids:
            return None
        top = max(gain[j] for j in ids)
        return next(j for j in ids if gain[j] >= top - 1e-12 * abs(top))

    def forward(self, terms: int, order: Sequence[int], tol: float = 1e-9):
        """Forward selection by the sweep operator: after every step the chosen
        terms, their coefficients, the intercept and the loss."""
        m = len(self.sf)
        A = np.empty((m + 1, m + 1))
        A[:m, :m], A[:m, m], A[m, :m], A[m, m] = self.C, self.cy, self.cy, self.yy
        chosen: list[int] = []
        first = np.diag(self.C).copy()
        for _ in range(terms):
            left = np.diag(A)[:m]
            allowed = self.spread & (left > tol * first)
            allowed[chosen] = False
            with np.errstate(divide="ignore", invalid="ignore"):
                j = self.best(A[:m, m] ** 2 / left, allowed, order)
            if j is None:
                return
            d = A[j, j]
            A = A - np.outer(A[:, j], A[j, :]) / d + _edge(A, j, d)
            chosen.append(j)
            coef = [float(A[i, m]) for i in chosen]
            yield list(chosen), coef, float((self.sy - np.dot(coef, self.sf[chosen])) / self.n), self.loss(A[m, m])


def _edge(A: np.ndarray, j: int, d: float) -> np.ndarray:
    """What row and column j of a swept matrix have beyond the update of the rest."""
    out = np.zeros_like(A)
    out[j, :] += A[j, :] / d
    out[:, j] += A[:, j] / d
    # the update left zeros in row and column j; the pivot becomes -1 / d
    out[j, j] = -1.0 / d
    return out


def _term_sums(n_keys: int, m: int, held: int):
    """Rows (keys, y, terms) -> partial sums (keys, n, packed sums)."""
    upper = np.triu_indices(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        names = types = None
        for b in batches:
            if not b.num_rows:
                continue
            names, types = b.schema.names[:n_keys], [f.type for f in b.schema][:n_keys]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(n_keys)))) if n_keys else [()] * b.num_rows
            seen: dict[tuple, int] = {}
            code = np.array([seen.setdefault(k, len(seen)) for k in keys])
            order = np.argsort(code, kind="stable")
            y = b.column(n_keys).to_numpy()[order]
            f = np.column_stack([b.column(n_keys + 1 + j).to_numpy(zero_copy_only=False) for j in range(m)])[order]
            known, f = ~np.isnan(f), np.nan_to_num(f, nan=0.0)
            code = code[order]
            ids = list(seen)
            for lo in range(0, len(y), ROWS_AT_ONCE):
                part = slice(lo, lo + ROWS_AT_ONCE)
                fp, yp, cp = f[part], y[part], code[part]
                rows = np.column_stack([yp, yp * yp, fp, fp * yp[:, None], known[part], fp[:, upper[0]] * fp[:, upper[1]]])
                starts = np.flatnonzero(np.diff(cp, prepend=-1))
                total = np.add.reduceat(rows, starts, axis=0)
                for i, n, t in zip(cp[starts], np.diff(np.append(starts, len(cp))), total):
                    have = sums.get(ids[i])
                    sums[ids[i]] = [int(n), t] if have is None else [have[0] + int(n), have[1] + t]
            if len(sums) > held:
                yield out(sums, names, types)
                sums = {}
        if sums:
            yield out(sums, names, types)

    def out(sums, names, types) -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*sums), types)] if names else []
        cols += [pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tobytes() for _, t in sums.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "n", "sums"])

    return run


def _group_sums(n_keys: int):
    """Sorted partial sums -> one row per group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for *key, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and now[0] == key:
                    now[1], now[2] = now[1] + n, now[2] + np.frombuffer(raw)
                else:
                    if now is not None:
                        done.append(now)
                    now = [key, n, np.frombuffer(raw)]
            yield out(done, b.schema)
            schema = b.schema
        if now is not None:
            yield out([now], schema)

    def out(rows, schema) -> pa.RecordBatch:
        cols = [pa.array([r[0][i] for r in rows], schema.types[i]) for i in range(n_keys)]
        cols += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


@dataclass
class Grams:
    """One row per group with the sums of all candidate terms, written once."""

    table: DataFrame  # __key0.., n, sums
    keys: list[str]
    xs: list[str]
    forms: Sequence[Form]

    @property
    def terms(self) -> list[tuple[str, Form]]:
        return [(x, f) for x in self.xs for f in self.forms]

    def order(self) -> list[int]:
        names = [(x, f.name) for x, f in self.terms]
        return sorted(range(len(names)), key=lambda j: names[j])

    def rows(self, of, extra: str, schema: str, table: DataFrame | None = None) -> DataFrame:
        """``of(gram, extra columns)`` -> rows of every group, beside its keys."""
        table = self.table if table is None else table
        k, m = len(self.keys), len(self.terms)
        hidden = [f"__key{i}" for i in range(k)]
        names = hidden + [c.split()[0] for c in schema.split(", ")]
        arrow = [_arrow_type(c.split()[1]) for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [[] for _ in names]
                for key in zip(*(c.to_pylist() for c in b.columns)):
                    for row in of(_Gram(key[k + 1], key[k], m), key[k + 2:]):
                        for col, v in zip(out, (*key[:k], *row)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [*b.schema.types[:k], *arrow])], names=names)

        picked = table.select(*hidden, "n", "sums", *extra.split())
        return _shown_keys(picked.mapInArrow(run, _key_schema(table, hidden) + schema), self.keys)


def _arrow_type(name: str) -> pa.DataType:
    one = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    return pa.list_(one[name[6:-1]]) if name.startswith("array<") else one[name]


def gram_table(df: DataFrame, keys: Sequence[str], x: str | Sequence[str], y: str, forms: Sequence[Form] = FORMS,
               min_rows: int = 3, held: int = HELD_GROUPS) -> Grams:
    """M5: one read of the rows. Every task adds up the products of all pairs
    of candidate terms per group; groups then meet by key, one row each, so
    equations of any number of terms need no other look at the rows."""
    names, xs = list(keys), [x] if isinstance(x, str) else list(x)
    df, hidden = _hidden_keys(df, names)
    terms = [f.spark(F.col(f"__x{p}")).cast("double").alias(f"__f{p}_{i}") for p in range(len(xs)) for i, f in enumerate(forms)]
    rows = _base(df, hidden, xs, y).select(*hidden, "__y", *terms)
    schema = _key_schema(rows, hidden) + "n long, sums binary"
    parts = rows.mapInArrow(_term_sums(len(hidden), len(terms), held), schema)
    met = parts.repartition(*hidden).sortWithinPartitions(*hidden) if hidden else parts.coalesce(1)
    table = materialize(met.mapInArrow(_group_sums(len(hidden)), schema).where(F.col("n") >= min_rows))
    return Grams(table, names, xs, list(forms))


_FIT = "predictor string, form string, complexity int, variant string, a double, b double, loss double, n long"


def fits_from_grams(grams: Grams) -> DataFrame:
    """The rows of :func:`fit_equations`, from the sums."""
    names = [(x, f.name, f.complexity) for x, f in grams.terms]

    def of(g: _Gram, _):
        n = g.n
        yield "", "const", 1, "const", 0.0, float(g.sy / n), g.loss(g.yy), n
        for j, (x, f, c) in enumerate(names):
            if g.valid[j] and g.G[j, j] > 0:
                a = g.sfy[j] / g.G[j, j]
                yield x, f, c + 2, "scaled", float(a), 0.0, g.loss(g.syy - a * g.sfy[j]), n
            if g.spread[j]:
                a = g.cy[j] / g.C[j, j]
                yield x, f, c + 4, "affine", float(a), float((g.sy - a * g.sf[j]) / n), g.loss(g.yy - a * g.cy[j]), n

    return grams.rows(of, "", _FIT)


def two_terms_from_grams(grams: Grams, fits: DataFrame | None = None) -> DataFrame:
    """M5 greedy step: keep each group's best affine term ``g1`` (of ``fits``
    when given) and fit ``y = a*g1 + a2*f + b`` for every other candidate.

    Output has the ``fit_equations`` columns plus ``predictor2, form2, a2``;
    complexity is ``c(f1) + c(f2) + 7`` (two products, two sums, three
    constants). Collinear pairs (centred determinant ~ 0) are dropped.
    """
    names = [(x, f.name, f.complexity) for x, f in grams.terms]
    at, order = {n[:2]: j for j, n in enumerate(names)}, grams.order()
    table, extra = grams.table, ""
    if fits is not None:
        w = Window.partitionBy(*grams.keys).orderBy("loss", "predictor", "form")
        first = (fits.where(F.col("variant") == "affine").withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
                 .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(grams.keys)], F.col("predictor").alias("p1"), F.col("form").alias("f1")))
        same = [F.col(f"__key{i}").eqNullSafe(F.col(f"__k{i}")) for i in range(len(grams.keys))]
        table = table.join(first, same, "inner") if same else table.crossJoin(F.broadcast(first))  # one row per group
        extra = "p1 f1"

    def of(g: _Gram, given):
        with np.errstate(divide="ignore", invalid="ignore"):
            i = at[given] if given else g.best(g.cy ** 2 / np.diag(g.C), g.spread, order)
        if i is None:
            return
        s11, s1y = g.C[i, i], g.cy[i]
        for j, (x, f, c) in enumerate(names):
            s22, s12, s2y = g.C[j, j], g.C[i, j], g.cy[j]
            det = s11 * s22 - s12 * s12
            if j == i or not g.spread[j] or not det > 1e-9 * s11 * s22:
                continue
            a1, a2 = (s22 * s1y - s12 * s2y) / det, (s11 * s2y - s12 * s1y) / det
            yield (names[i][0], names[i][1], names[i][2] + c + 7, "two_term", float(a1), float((g.sy - a1 * g.sf[i] - a2 * g.sf[j]) / g.n),
                   g.loss(g.yy - a1 * s1y - a2 * s2y), g.n, x, f, float(a2))

    return grams.rows(of, extra, _FIT + ", predictor2 string, form2 string, a2 double", table)


def fit_two_term(df: DataFrame, keys: Sequence[str], x: str | Sequence[str], y: str, forms: Sequence[Form] = FORMS,
                 min_rows: int = 3, fits: DataFrame | None = None) -> DataFrame:
    """:func:`two_terms_from_grams` of one read of the rows."""
    return two_terms_from_grams(gram_table(df, keys, x, y, forms, min_rows), fits)


def fit_forward(df: DataFrame | Grams, keys: Sequence[str] = (), x: str | Sequence[str] = (), y: str = "", terms: int = 3,
                forms: Sequence[Form] = FORMS, min_rows: int = 3, digits: int = 7) -> DataFrame:
    """M5: forward selection of up to ``terms`` terms per group, each the one
    that lowers the loss most beside those chosen (equal ones by predictor,
    form). One row per group and step: step, complexity, predictors, forms,
    coefficients, b, loss, n and the printed equation (M8)."""
    grams = df if isinstance(df, Grams) else gram_table(df, keys, x, y, forms, min_rows)
    names, order = [(x_, f.name, f.complexity, f.text.format(x=x_)) for x_, f in grams.terms], grams.order()

    def of(g: _Gram, _):
        for chosen, coef, b, loss in g.forward(terms, order):
            text = " + ".join(f"({a:.{digits}g} * {names[j][3]})" for j, a in zip(chosen, coef)) + f" + {b:.{digits}g}"
            yield (len(chosen), sum(names[j][2] for j in chosen) + 3 * len(chosen) + 1, [names[j][0] for j in chosen],
                   [names[j][1] for j in chosen], coef, b, loss, g.n, text)

    return grams.rows(of, "", "step int, complexity int, predictors array<string>, forms array<string>, coefficients array<double>, "
                              "b double, loss double, n long, equation string")


def with_two_term(fits: DataFrame, two: DataFrame) -> DataFrame:
    """Single-term fits (``predictor2 = form2 = ''``, ``a2 = 0``) plus two-term fits."""
    one = fits.withColumn("predictor2", F.lit("")).withColumn("form2", F.lit("")).withColumn("a2", F.lit(0.0))
    return one.unionByName(two)


def hall_of_fame(fits: DataFrame, keys: Sequence[str], parsimony: float = 1.5) -> DataFrame:
    """Best fit per (group, complexity); keep a row when its loss is
    below every simpler row's (Pareto front); score
    ``-(ln loss_k - ln loss_prev)/(c_k - c_prev)`` (first 0); ``chosen`` =
    highest score among rows with ``loss <= parsimony * min loss``.
    All windows are per group over at most one row per complexity."""
    keys = list(keys)
    order = ["loss", "predictor", "form", "variant"] + [c for c in ("predictor2", "form2") if c in fits.columns]
    w_best = Window.partitionBy(*keys, "complexity").orderBy(*order)
    best = fits.withColumn("__r", F.row_number().over(w_best)).where(F.col("__r") == 1).drop("__r")
    w = Window.partitionBy(*keys).orderBy("complexity")
    prior_min = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("__pm", prior_min).where(F.col("__pm").isNull() | (F.col("loss") < F.col("__pm")))
    prev_l, prev_c = F.lag("loss").over(w), F.lag("complexity").over(w)
    eps = F.lit(1e-300)
    score = F.when(prev_l.isNull(), F.lit(0.0)).otherwise(
        -(F.ln(F.greatest(F.col("loss"), eps)) - F.ln(F.greatest(prev_l, eps))) / (F.col("complexity") - prev_c))
    front = front.drop("__pm").withColumn("score", score)
    wg = Window.partitionBy(*keys)
    elig = F.col("loss") <= parsimony * F.min("loss").over(wg)
    front = front.withColumn("__s", F.when(elig, F.col("score")))
    w_pick = Window.partitionBy(*keys).orderBy(F.col("__s").desc_nulls_last(), "complexity")
    return front.withColumn("chosen", F.row_number().over(w_pick) == 1).drop("__s")


def _term(pred: str, form: str, xs: Sequence[str], forms: Sequence[Form]):
    """Value of the term that columns ``pred`` and ``form`` name."""
    out = F.lit(None).cast("double")
    for x in xs:
        for f in forms:
            hit = (F.col(pred) == x) & (F.col(form) == f.name)
            out = F.when(hit, f.spark(F.col(f"`{x}`").cast("double"))).otherwise(out)
    return out


def predict(df: DataFrame, chosen: DataFrame, keys: Sequence[str], x: str | Sequence[str], out: str = "prediction",
            forms: Sequence[Form] = FORMS) -> DataFrame:
    """M7: evaluate each group's chosen equation, of one or two terms, each on
    its own predictor (parameters joined by group; the chosen table has one
    row per group). ``x`` lists the predictors the fits may name; a chosen
    predictor outside ``x`` fails the job rather than giving another's value."""
    keys = list(keys)
    xs = [x] if isinstance(x, str) else list(x)
    two = "predictor2" in chosen.columns
    second = [F.col(c).alias(f"__{c}") for c in ("predictor2", "form2", "a2")] if two else []
    params = chosen.where("chosen").select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)],
                                           F.col("form").alias("__form"), F.col("a").alias("__a"),
                                           F.col("b").alias("__b"), F.col("predictor").alias("__pred"),
                                           F.col("variant").alias("__variant"), *second)
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    j = df.join(params, same, "left") if keys else df.crossJoin(F.broadcast(params))
    known = F.col("__pred").isin("", *xs) & (F.col("__predictor2").isin("", *xs) if two else F.lit(True))
    value = F.col("__a") * _term("__pred", "__form", xs, forms) + F.col("__b")
    expr = F.when(F.col("__form") == "const", F.col("__b"))
    if two:
        expr = expr.when(F.col("__variant") == "two_term", value + F.col("__a2") * _term("__predictor2", "__form2", xs, forms))
    expr = F.when(~known, F.raise_error(F.concat(F.lit("equation on a predictor outside "), F.lit(", ".join(xs))))
                  .cast("double")).otherwise(expr.otherwise(value))
    return j.select(*[F.col(f"`{c}`") for c in df.columns if c != out], expr.alias(out))


def equation_text(hof: DataFrame, x_name: str | None = None, forms: Sequence[Form] = FORMS, digits: int = 7) -> DataFrame:
    """M8: printed equation per hall-of-fame row, each term with its own
    predictor's name (``x_name`` replaces it when given)."""
    fmt = f"%.{digits}g"

    def term(pred: str, form: str):
        out = F.lit(None).cast("string")
        for f in forms:
            parts = f.text.split("{x}")
            name = F.lit(x_name) if x_name else F.col(pred)
            text = F.concat(*[p for i, part in enumerate(parts) for p in ([name] if i else []) + [F.lit(part)]])
            out = F.when(F.col(form) == f.name, text).otherwise(out)
        return out

    first = F.concat(F.format_string(f"({fmt} * ", F.col("a")), term("predictor", "form"), F.lit(")"))
    plus = F.format_string(f" + {fmt}", F.col("b"))
    text = F.when(F.col("form") == "const", F.format_string(fmt, F.col("b"))) \
        .when(F.col("variant") == "scaled", first).when(F.col("variant") == "affine", F.concat(first, plus))
    if "predictor2" in hof.columns:
        second = F.concat(F.format_string(f" + ({fmt} * ", F.col("a2")), term("predictor2", "form2"), F.lit(")"))
        text = text.when(F.col("variant") == "two_term", F.concat(first, second, plus))
    return hof.withColumn("equation", text)
