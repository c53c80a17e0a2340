"""Linear mixed models with a correlated random intercept and slope per
group, for any number of responses that share a design; REML or ML, type III F
tests with Satterthwaite degrees of freedom (survey J6).

Per group i with ``Z_i = [1, z]`` the marginal covariance is
``s2 V_i = s2 (I + Z_i Lam Z_i')``, ``Lam = L L'``; by Woodbury everything the
likelihood and its derivatives need depends on the group only through
``Z_i'Z_i`` and ``W_i = Z_i'[X Y]``.

One scan: every task reduces its rows to ``[X Y]'[X Y]`` (one row per task)
and to partial ``W_i`` (one row per batch and group). Groups then meet by id,
and groups with one pattern (n, sum z, sum z^2) by pattern. The rows of a
pattern enter every quantity as a sum of outer products, so they are replaced
by the triangular factor of their QR decomposition, at most as many rows as
``W_i`` has entries: a pattern that all groups share shrinks map-side to a few
rows, and patterns that only one group has cost no more than the group itself.
There is no switch between the two cases.

Fit: every iteration evaluates the deviance, its exact gradient and Hessian of
all unfinished responses in one job over the pattern rows, and the driver makes
a damped Newton step in the three entries of L. The result says whether it
converged and after how many evaluations. The same derivatives give the
Satterthwaite degrees of freedom, without differences.

Rows with a null in any used column are left out for all responses given
together; ``missing_classes`` splits responses with different gaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import tails
from panelkit.operators.mixed import Design
from panelkit.session import materialize

#: Rows of W held by a task before it sends its patterns on.
HELD = 50_000
MAX_EVALUATIONS = 40
SINGULAR = 1e-4
_ROW = "kind int, k0 double, k1 double, k2 double, n double, sz double, szz double, count double, w binary"
_NAMES = ["kind", "k0", "k1", "k2", "n", "sz", "szz", "count", "w"]


@dataclass
class SlopeStats:
    names: list[str]
    responses: list[str]
    N: int
    G: int
    XtX: np.ndarray
    XtY: np.ndarray
    YtY: np.ndarray  # diagonal
    scale: float  # root mean square of z: L is relative to z / scale
    rows: DataFrame  # one row per pattern and row of its factor

    def cross(self, r: int) -> np.ndarray:
        """[X y]'[X y] of a response."""
        p = len(self.XtX)
        out = np.empty((p + 1, p + 1))
        out[:p, :p] = self.XtX
        out[:p, p] = out[p, :p] = self.XtY[:, r]
        out[p, p] = self.YtY[r]
        return out


def missing_classes(df: DataFrame, ys: Sequence[str]) -> list[list[str]]:
    """Responses without nulls together, every other one alone."""
    gaps = df.agg(*[F.count_if(F.col(y).isNull()).alias(f"c{i}") for i, y in enumerate(ys)]).first()
    whole = [y for i, y in enumerate(ys) if not gaps[i]]
    return ([whole] if whole else []) + [[y] for i, y in enumerate(ys) if gaps[i]]


# ------------------------------------------------------------------ statistics
def _batch(rows: list) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.float64()] * 7 + [pa.binary()]
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)


def _scan(p: int, k: int):
    """Rows (g, z, x.., y..) -> partial (g, n, sz, szz, w), and per task one row
    without a group that packs sum z^2, X'X, X'Y and the diagonal of Y'Y."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, zz, n_all = np.zeros(p * p + p * k + k), 0.0, 0
        for b in batches:
            # incomplete rows go here: as a filter over all columns they keep the optimizer busy for minutes
            values = np.column_stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(1, 2 + p + k)])
            known = ~np.isnan(values).any(axis=1) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not known.any():
                continue
            coded = b.column(0).filter(pa.array(known)).dictionary_encode()
            code, ids = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            z, A = values[known, 0], values[known, 1:]
            X, Y = A[:, :p], A[:, p:]
            total += np.concatenate([(X.T @ X).ravel(), (X.T @ Y).ravel(), (Y * Y).sum(axis=0)])
            zz, n_all = zz + float(z @ z), n_all + len(z)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            parts = np.column_stack([np.ones(len(z)), z, z * z, A, A * z[:, None]])[order]
            sums = np.add.reduceat(parts, starts, axis=0)
            yield out([ids[c] for c in code[order][starts]], sums[:, :3], sums[:, 3:])
        yield out([None], np.array([[n_all, 0.0, zz]]), total[None])

    def out(ids, head, w):
        cols = [pa.array(ids, pa.string()), *[pa.array(head[:, j]) for j in range(3)], pa.array([v.tobytes() for v in w], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["g", "n", "sz", "szz", "w"])

    return run


def _keys(n: float, sz: float, szz: float) -> tuple:
    """Pattern of a group, the same in any unit of z: groups agree to 9
    decimals of sum z over its bound, and to 10 digits of sum z^2."""
    return n, (round(sz / math.sqrt(n * szz), 9) + 0.0 if szz else 0.0), float(f"{szz:.9e}")


class _Patterns:
    """Rows of W by pattern, kept to the size of their triangular factor."""

    def __init__(self, width: int):
        self.width, self.of, self.held = width, {}, 0

    def add(self, key: tuple, sz: float, szz: float, count: float, rows: list) -> None:
        p = self.of.setdefault(key, [0.0, 0.0, 0.0, []])
        p[0], p[1], p[2] = p[0] + count, p[1] + count * sz, p[2] + count * szz
        p[3].extend(rows)
        self.held += len(rows)
        if len(p[3]) >= 4 * self.width:
            self.held -= len(p[3])
            p[3] = self.factor(p[3])
            self.held += len(p[3])

    def factor(self, rows: list) -> list:
        return list(np.linalg.qr(np.array(rows), mode="r")) if len(rows) > self.width else rows

    def drain(self) -> list:
        out = []
        for key, (count, sz, szz, rows) in self.of.items():
            mean = (sz / count, szz / count)
            out += [(1, *key, key[0], *mean, count if i == 0 else 0.0, r.tobytes()) for i, r in enumerate(self.factor(rows))]
        self.of, self.held = {}, 0
        return out


def _by_group(width: int, held: int):
    """Sorted partial rows -> pattern rows (kind 1) and the summed packs (kind 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, now, head, w = _Patterns(width), None, None, None

        def close():
            if now is not None:
                n, sz, szz = head
                patterns.add(_keys(n, sz, szz), sz, szz, 1.0, [w])

        for b in batches:
            packs = []
            for g, n, sz, szz, raw in zip(*(c.to_pylist() for c in b.columns)):
                if g is None:
                    packs.append((0, None, None, None, n, sz, szz, 0.0, raw))
                elif g == now:
                    head, w = head + np.array([n, sz, szz]), w + np.frombuffer(raw)
                else:
                    close()
                    now, head, w = g, np.array([n, sz, szz]), np.frombuffer(raw)
            if patterns.held > held:
                packs += patterns.drain()
            yield _batch(packs)
        close()
        yield _batch(patterns.drain())

    return run


def _by_pattern(width: int, held: int):
    """Sorted pattern rows -> factors of whole patterns; packs summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, now, packs = _Patterns(width), None, None
        for b in batches:
            done = []
            for kind, k0, k1, k2, n, sz, szz, count, raw in zip(*(c.to_pylist() for c in b.columns)):
                w = np.frombuffer(raw)
                if kind == 0:
                    packs = (n, szz, w) if packs is None else (packs[0] + n, packs[1] + szz, packs[2] + w)
                    continue
                key = (k0, k1, k2)
                if key != now and patterns.held > held:
                    done += patterns.drain()
                now = key
                patterns.add(key, sz, szz, count, [w])
            yield _batch(done)
        if packs is not None:
            patterns_rows = [(0, None, None, None, packs[0], 0.0, packs[1], 0.0, packs[2].tobytes())]
            yield _batch(patterns_rows)
        yield _batch(patterns.drain())

    return run


def slope_stats(df: DataFrame, ys: str | Sequence[str], design: Design, group: str, z: str, held: int = HELD) -> SlopeStats:
    """Sufficient statistics of all responses from one scan of ``df``."""
    ys = [ys] if isinstance(ys, str) else list(ys)
    p, k = len(design.terms), len(ys)
    width = 2 * (p + k)
    base = df.select(F.col(group).cast("string").alias("g"), F.col(z).cast("double").alias("z"),
                     *[c.cast("double").alias(f"x{j}") for j, (_, c) in enumerate(design.terms)],
                     *[F.col(y).cast("double").alias(f"y{j}") for j, y in enumerate(ys)])
    partial = base.mapInArrow(_scan(p, k), "g string, n double, sz double, szz double, w binary")
    groups = partial.repartition("g").sortWithinPartitions("g").mapInArrow(_by_group(width, held), _ROW)
    keys = ["kind", "k0", "k1", "k2"]
    rows = materialize(groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_pattern(width, held), _ROW))
    pack = rows.where("kind = 0").first()  # one row: sums of the design's size
    G = int(rows.agg(F.sum("count")).first()[0] or 0)
    if not G:
        raise ValueError("no complete rows")
    w = np.frombuffer(pack["w"])
    N = int(pack["n"])
    scale = math.sqrt(pack["szz"] / N) or 1.0
    return SlopeStats(design.names(), ys, N, G, w[:p * p].reshape(p, p), w[p * p:p * p + p * k].reshape(p, k), w[p * p + p * k:],
                      scale, rows.where("kind = 1"))


# ------------------------------------------------------------------ deviance and derivatives
#: Entries of L by parameter, and the pairs of a symmetric 3 x 3 matrix.
_L_OF = ((0, 0), (1, 0), (1, 1))
_PAIRS = [(a, b) for a in range(3) for b in range(a, 3)]


def _lower(theta) -> np.ndarray:
    return np.array([[theta[0], 0.0], [theta[1], theta[2]]])


def _unit(a: int) -> np.ndarray:
    out = np.zeros((2, 2))
    out[_L_OF[a]] = 1.0
    return out


def _lam(theta) -> tuple[np.ndarray, list, dict]:
    """Lam = L L', its first and second derivatives in the entries of L."""
    L = _lower(theta)
    first = [_unit(a) @ L.T + L @ _unit(a).T for a in range(3)]
    second = {(a, b): _unit(a) @ _unit(b).T + _unit(b) @ _unit(a).T for a, b in _PAIRS}
    return L @ L.T, first, second


def _sums(p: int, k: int, scale: float, asked: Sequence[tuple[int, tuple]]):
    """Per asked (response, theta): what the pattern rows add to log|V| and
    [X y]'V^-1[X y], with first and second derivatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            n, sz, szz, count = (b.column(c).to_numpy() for c in ("n", "sz", "szz", "count"))
            W = np.array([np.frombuffer(w) for w in b.column("w").to_pylist()]).reshape(-1, 2, p + k)
            W = W * np.array([1.0, 1.0 / scale])[:, None]
            ZZ = np.empty((len(n), 2, 2))
            ZZ[:, 0, 0], ZZ[:, 0, 1], ZZ[:, 1, 0], ZZ[:, 1, 1] = n, sz / scale, sz / scale, szz / scale ** 2
            for at, (r, theta) in enumerate(asked):
                part = one(ZZ, count, W[:, :, [*range(p), p + r]], theta)
                total[at] = part if at not in total else total[at] + part
        cols = [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["at", "v"])

    def one(ZZ, count, W, theta) -> np.ndarray:
        lam, first, second = _lam(theta)
        det = np.eye(2) + ZZ @ lam
        K = np.linalg.inv(det)
        A = K @ ZZ
        V = K @ W  # Z'V^-1 [X y]

        def met(M):  # sum of V' M V, M one 2 x 2 matrix or one per row
            return np.einsum("rai,raj->ij", V, M @ V, optimize=True)

        AF = [A @ f for f in first]
        trace = lambda M: float(count @ np.trace(M, axis1=1, axis2=2))
        head = [float(count @ np.log(np.linalg.det(det)))] + [trace(x) for x in AF] \
            + [trace(A @ second[a, b]) - trace(AF[a] @ AF[b]) for a, b in _PAIRS]
        mats = [-np.einsum("rai,raj->ij", W, lam @ V, optimize=True)] + [-met(f) for f in first] \
            + [met(first[a] @ AF[b] + first[b] @ AF[a] - second[a, b]) for a, b in _PAIRS]
        return np.concatenate([head, *[m.ravel() for m in mats]])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at, v in zip(b.column("at").to_pylist(), b.column("v").to_pylist()):
            x = np.frombuffer(v)
            total[at] = x if at not in total else total[at] + x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                     names=["at", "v"])


@dataclass
class Point:
    """Profiled deviance of one response at theta, with derivatives."""

    theta: np.ndarray
    dev: float
    grad: np.ndarray
    hess: np.ndarray
    beta: np.ndarray
    s2: float
    rss: float
    inverse: np.ndarray  # (X'V^-1X)^-1
    C: list  # derivatives of X'V^-1X
    rss1: np.ndarray
    rss2: np.ndarray
    rest1: np.ndarray  # derivatives of log|V| (+ log|X'V^-1X|)
    rest2: np.ndarray


def evaluate(st: SlopeStats, asked: Mapping[int, Sequence[float]], reml: bool = True) -> dict[int, Point]:
    """Deviance, gradient and Hessian of all asked responses, in one job; the
    driver receives arrays of the design's size."""
    p, k = len(st.names), len(st.responses)
    order = [(r, tuple(float(x) for x in t)) for r, t in asked.items()]
    schema = "at int, v binary"
    parts = st.rows.select("n", "sz", "szz", "count", "w").mapInArrow(_sums(p, k, st.scale, order), schema)
    got = {r["at"]: np.frombuffer(r["v"]) for r in parts.repartition("at").mapInArrow(_added, schema).collect()}
    return {r: _point(st, r, np.array(t), got[at], reml) for at, (r, t) in enumerate(order)}


def _point(st: SlopeStats, r: int, theta: np.ndarray, v: np.ndarray, reml: bool) -> Point:
    p = len(st.names)
    q = p + 1
    head, mats = v[:10], v[10:].reshape(10, q, q)
    M = st.cross(r) + mats[0]
    C = M[:p, :p]
    inverse = np.linalg.inv(C)
    beta = inverse @ M[:p, p]
    rss = float(M[p, p] - M[:p, p] @ beta)
    w = np.append(-beta, 1.0)
    rss1, rest1 = np.zeros(3), head[1:4].copy()
    rss2, rest2 = np.zeros((3, 3)), np.zeros((3, 3))
    slopes = [m @ w for m in mats[1:4]]
    for a in range(3):
        rss1[a] = w @ slopes[a]
    for i, (a, b) in enumerate(_PAIRS):
        rss2[a, b] = rss2[b, a] = w @ mats[4 + i] @ w - 2 * slopes[a][:p] @ inverse @ slopes[b][:p]
        rest2[a, b] = rest2[b, a] = head[4 + i]
    logdet = head[0]
    C1 = [m[:p, :p] for m in mats[1:4]]
    if reml:
        logdet += np.linalg.slogdet(C)[1]
        IC = [inverse @ c for c in C1]
        rest1 += [np.trace(x) for x in IC]
        for i, (a, b) in enumerate(_PAIRS):
            t = np.trace(inverse @ mats[4 + i][:p, :p]) - np.trace(IC[a] @ IC[b])
            rest2[a, b] += t
            rest2[b, a] = rest2[a, b]
    nu = st.N - p if reml else st.N
    s2 = rss / nu
    dev = nu * (math.log(2 * math.pi * s2) + 1) + logdet
    grad = nu * rss1 / rss + rest1
    hess = nu * (rss2 / rss - np.outer(rss1, rss1) / rss ** 2) + rest2
    return Point(theta, float(dev), grad, hess, beta, s2, rss, inverse, C1, rss1, rss2, rest1, rest2)


# ------------------------------------------------------------------ fit
@dataclass
class SlopeFit:
    response: str
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    s2: float
    D: np.ndarray  # covariance of intercept and slope, in the unit of z
    deviance: float
    reml: bool
    random_structure: str
    converged: bool
    evaluations: int
    point: Point
    nu: int

    @property
    def free(self) -> list[int]:
        return [0] if self.random_structure == "intercept" else [0, 1, 2]


def _minimise(st: SlopeStats, starts: Mapping[int, np.ndarray], free: list[int], reml: bool, most: int):
    """Damped Newton for every response at once. Returns response -> (point,
    converged, evaluations)."""
    best = evaluate(st, starts, reml)
    damp = {r: 0.0 for r in starts}
    used = {r: 1 for r in starts}
    done: dict[int, bool] = {}
    while len(done) < len(starts):
        tries = {}
        for r in starts:
            if r in done:
                continue
            b = best[r]
            g, H = b.grad[free], b.hess[np.ix_(free, free)]
            vals, vecs = np.linalg.eigh(H)
            scale = max(np.abs(vals).max(), 1e-12)
            step = -vecs @ ((vecs.T @ g) / (np.maximum(np.abs(vals), 1e-10 * scale) + damp[r]))
            step *= min(1.0, 2.0 * max(1.0, np.abs(b.theta).max()) / max(np.abs(step).max(), 1e-300))
            if abs(float(g @ step)) < 1e-11 * (1 + abs(b.dev)) and vals.min() > -1e-6 * scale:
                done[r] = True
            elif used[r] >= most or damp[r] > 1e12 * scale:
                done[r] = False
            else:
                tries[r] = b.theta.copy()
                tries[r][free] += step
        if not tries:
            break
        for r, new in evaluate(st, tries, reml).items():
            used[r] += 1
            scale = max(np.abs(best[r].hess).max(), 1e-12)
            if new.dev <= best[r].dev + 1e-13 * abs(best[r].dev):
                best[r], damp[r] = new, (damp[r] / 10 if damp[r] > 1e-9 * scale else 0.0)
            else:
                damp[r] = max(10 * damp[r], 1e-3 * scale)
    return {r: (best[r], done[r], used[r]) for r in starts}


def fit_random_slope(st: SlopeStats, reml: bool = True, singular_tol: float = SINGULAR,
                     most: int = MAX_EVALUATIONS) -> dict[str, SlopeFit]:
    """Response -> fit. A response whose slope model is singular gets the
    random intercept instead, as does one whose slope model does not converge."""
    ids = range(len(st.responses))
    found = _minimise(st, {r: np.array([1.0, 0.0, 1.0]) for r in ids}, [0, 1, 2], reml, most)
    weak = {r for r in ids if not found[r][1] or min(abs(found[r][0].theta[0]), abs(found[r][0].theta[2])) < singular_tol}
    if weak:
        again = _minimise(st, {r: np.array([max(abs(found[r][0].theta[0]), 0.1), 0.0, 0.0]) for r in weak}, [0], reml, most)
        found.update({r: (b, ok, found[r][2] + n) for r, (b, ok, n) in again.items()})
    out = {}
    for r, y in enumerate(st.responses):
        b, ok, n = found[r]
        unit = np.diag([1.0, 1.0 / st.scale])
        D = b.s2 * unit @ _lam(b.theta)[0] @ unit
        out[y] = SlopeFit(y, st.names, b.beta, b.s2 * b.inverse, b.s2, D, b.dev, reml,
                          "intercept" if r in weak else "intercept+slope", ok, n, b, st.N - len(st.names) if reml else st.N)
    return out


def _satterthwaite(fit: SlopeFit) -> tuple[np.ndarray, list]:
    """Asymptotic covariance of (theta, s2) and the derivatives of the
    coefficients' covariance in them, both exact."""
    b, free, s2 = fit.point, fit.free, fit.s2
    k = len(free)
    H = np.zeros((k + 1, k + 1))
    H[:k, :k] = b.rss2[np.ix_(free, free)] / s2 + b.rest2[np.ix_(free, free)]
    H[:k, k] = H[k, :k] = -b.rss1[free] / s2 ** 2
    H[k, k] = fit.nu / s2 ** 2
    grads = [-s2 * b.inverse @ b.C[a] @ b.inverse for a in free] + [b.inverse]
    return 2 * np.linalg.pinv(H), grads


def type3_tests(spark, fits: Mapping[str, SlopeFit], terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per response and term the Wald F (columns listed in ``terms``) with
    Satterthwaite denominator df, p, partial eta squared
    ``F df1 / (F df1 + df2)`` with its two-sided 95 % noncentral-F interval,
    the random structure, ``converged`` and ``evaluations``."""
    rows = []
    for dv, fit in fits.items():
        A, grads = _satterthwaite(fit)
        idx = {n: i for i, n in enumerate(fit.names)}
        for term, cols in terms.items():
            q = len(cols)
            Lm = np.zeros((q, len(fit.names)))
            Lm[range(q), [idx[c] for c in cols]] = 1.0
            LCL = Lm @ fit.cov @ Lm.T
            Fv = float(fit.beta @ Lm.T @ np.linalg.solve(LCL, Lm @ fit.beta)) / q
            vals, vecs = np.linalg.eigh(LCL)
            nus = []
            for m in range(q):
                lm = vecs[:, m] @ Lm
                g = np.array([lm @ G @ lm for G in grads])
                nus.append(2 * vals[m] ** 2 / float(g @ A @ g))
            if q == 1:
                df2 = nus[0]
            else:
                E = sum(v / (v - 2) for v in nus if v > 2)
                df2 = 2 * E / (E - q) if E > q else float("nan")
            eta = Fv * q / (Fv * q + df2) if df2 == df2 else float("nan")
            lo, hi = tails.eta2_partial_ci(Fv, q, df2)
            rows.append((dv, term, q, float(df2), Fv, float(tails.f_upper(Fv, q, df2)), float(eta), float(lo), float(hi),
                         fit.random_structure, fit.converged, fit.evaluations))
    return spark.createDataFrame(rows, "dv string, term string, NumDF int, DenDF double, F double, p double, "
                                       "eta2_partial double, eta2_CI_low double, eta2_CI_high double, "
                                       "random_structure string, converged boolean, evaluations int")
