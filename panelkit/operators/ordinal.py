"""Cumulative-link (proportional odds, logit) mixed models with a random
intercept per group, for any number of responses that share a design
(survey J7).

``P(Y <= k | v) = F(theta_k - x'beta - sigma v)``, ``v ~ N(0, 1)``. Every group's
likelihood is integrated by adaptive Gauss-Hermite quadrature: a damped Newton
search finds the mode of its integrand, the curvature there sets the spread of
the nodes. Fixed nodes miss the peak of a large group (200 rows make it ten
times narrower than the prior); adaptive ones follow it.

One scan collects the rows: equal (group, design row, classes) are counted
map-side, and the rows of a group are packed into one row of arrays, which is
written once. An evaluation is one job over the packed groups for all
unfinished responses: log-likelihood, gradient and Hessian come from the same
nodes (Louis' identity: expected complete-data information less the posterior
covariance of the score). The driver holds one matrix of the parameters' size
per response and makes damped Newton steps; standard errors are read from the
same Hessian. ``converged`` and ``evaluations`` are part of the result.

A row with a null design column is left out; a null class leaves the row out
for that response only. The distinct rows of one group sit in one task.
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

NODES = 15
MAX_EVALUATIONS = 60
#: (row, node) pairs evaluated at a time.
CELLS = 2_000_000
MODE_STEPS = 50


@dataclass
class OrdinalStats:
    names: list[str]
    responses: list[str]
    classes: list[int]
    shares: list[np.ndarray]  # rows per class
    groups: DataFrame  # g, x, y, w packed
    nodes: int


def _pack(p: int, k: int):
    """Sorted rows (g, x.., y.., w) -> one row per group of packed arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            X = np.column_stack([b.column(1 + j).to_numpy(zero_copy_only=False) for j in range(p)]) if p else np.zeros((b.num_rows, 0))
            whole = ~np.isnan(X).any(axis=1) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not whole.any():
                continue
            g = b.column(0).filter(pa.array(whole)).to_pylist()
            X = X[whole]
            Y = np.column_stack([b.column(1 + p + j).to_numpy(zero_copy_only=False) for j in range(k)]).astype(np.int32)[whole]
            w = b.column(1 + p + k).to_numpy().astype(float)[whole]
            cuts = [0] + [i for i in range(1, len(g)) if g[i] != g[i - 1]] + [len(g)]
            done = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if parts and g[lo] != now:
                    done.append((now, parts))
                    parts = []
                now = g[lo]
                parts = [*parts, (X[lo:hi], Y[lo:hi], w[lo:hi])]
            yield out(done)
        if parts:
            yield out([(now, parts)])

    def out(done: list) -> pa.RecordBatch:
        cols = [[g for g, _ in done]] + [[np.concatenate([t[i] for t in parts]).tobytes() for _, parts in done] for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary(), pa.binary()))],
                                          names=["g", "x", "y", "w"])

    return run


def ordinal_stats(df: DataFrame, ys: str | Sequence[str], design: Design, group: str, classes: int | Sequence[int],
                  nodes: int = NODES) -> OrdinalStats:
    """The packed groups of all responses, from one scan. Responses hold
    classes 0..K-1; ``design`` has no intercept (the thresholds carry it)."""
    ys = [ys] if isinstance(ys, str) else list(ys)
    sizes = [classes] * len(ys) if isinstance(classes, int) else list(classes)
    p, k = len(design.terms), len(ys)
    xs, yc = [f"x{j}" for j in range(p)], [f"y{j}" for j in range(k)]
    rows = df.select(F.col(group).cast("string").alias("g"), *[c.cast("double").alias(f"x{j}") for j, (_, c) in enumerate(design.terms)],
                     *[F.coalesce(F.col(y).cast("int"), F.lit(-1)).alias(f"y{j}") for j, y in enumerate(ys)])
    counted = rows.groupBy("g", *xs, *yc).agg(F.count(F.lit(1)).alias("w"))
    packed = counted.repartition("g").sortWithinPartitions("g").mapInArrow(_pack(p, k), "g string, x binary, y binary, w binary")
    groups = materialize(packed)
    totals = _class_totals(groups, k, max(sizes))
    return OrdinalStats(design.names(), ys, sizes, [totals[j, :s] for j, s in enumerate(sizes)], groups, nodes)


def _class_totals(groups: DataFrame, k: int, most: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, most))
        for b in batches:
            for y, w in zip(b.column("y").to_pylist(), b.column("w").to_pylist()):
                Y, weight = np.frombuffer(y, np.int32).reshape(-1, k), np.frombuffer(w)
                for j in range(k):
                    ok = (Y[:, j] >= 0) & (Y[:, j] < most)
                    total[j] += np.bincount(Y[ok, j], weight[ok], most)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "v"])

    parts = groups.select("y", "w").mapInArrow(run, "at int, v binary").collect()  # one small array per task
    return sum((np.frombuffer(r["v"]).reshape(k, most) for r in parts), np.zeros((k, most)))


# ------------------------------------------------------------------ one evaluation
def _link(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic distribution function, density and its derivative."""
    F_ = 1.0 / (1.0 + np.exp(-np.clip(t, -700, 700)))
    f = F_ * (1.0 - F_)
    return F_, f, f * (1.0 - 2.0 * F_)


def _derivatives(y: np.ndarray, theta: np.ndarray, at: np.ndarray):
    """log P(y) and its first and second derivatives in the two thresholds
    around y, for linear predictors ``at`` (rows x nodes)."""
    K = len(theta) + 1
    ends = np.concatenate([[-np.inf], theta, [np.inf]])
    top, bottom = y == K - 1, y == 0
    with np.errstate(invalid="ignore"):
        Fa, fa, da = _link(ends[y + 1][:, None] - at)
        Fb, fb, db = _link(ends[y][:, None] - at)
    Fa[top], fa[top], da[top] = 1.0, 0.0, 0.0
    Fb[bottom], fb[bottom], db[bottom] = 0.0, 0.0, 0.0
    P = np.maximum(Fa - Fb, 1e-300)
    la, lb = fa / P, -fb / P
    return np.log(P), la, lb, da / P - la * la, -db / P - lb * lb, -la * lb


def _group_terms(X, y, w, starts, psi, K, t, lw):
    """Summed log-likelihood, gradient and Hessian in (theta, beta, sigma) of
    whole groups; ``starts``: first row of every group."""
    p, m = X.shape[1], K - 1
    theta, beta, sigma = psi[:m], psi[m:m + p], psi[m + p]
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(y))))
    eta = X @ beta
    add = lambda v: np.add.reduceat(v, starts, axis=0)
    # modes of sum log P - v^2 / 2: concave in v, so a damped Newton search ends
    v = np.zeros(len(starts))
    for _ in range(MODE_STEPS):
        _, la, lb, aa, bb, ab = (d[:, 0] for d in _derivatives(y, theta, (eta + sigma * v[of])[:, None]))
        slope = -sigma * add(w * (la + lb)) - v
        curve = sigma ** 2 * add(w * (aa + bb + 2 * ab)) - 1.0
        step = np.clip(-slope / curve, -1.0, 1.0)
        v = v + step
        if np.abs(step).max() < 1e-8:
            break
    spread = 1.0 / np.sqrt(-curve)
    V = v[:, None] + math.sqrt(2.0) * spread[:, None] * t  # groups x nodes
    Vr = V[of]
    ll, la, lb, aa, bb, ab = _derivatives(y, theta, eta[:, None] + sigma * Vr)
    W = w[:, None]
    S = add(W * ll) + lw + t * t - V * V / 2 + np.log(spread)[:, None]  # log(sqrt(2) spread / sqrt(2 pi)) less constants in lw
    top = S.max(axis=1, keepdims=True)
    E = np.exp(S - top)
    Z = E.sum(axis=1, keepdims=True)
    total = float((top[:, 0] + np.log(Z[:, 0])).sum())
    post = E / Z
    Q = post[of] * W
    # scores per group and node
    G, n = len(starts), len(psi)
    score = np.zeros((G, len(t), n))
    for k in range(m):
        score[:, :, k] = add(W * (np.where((y == k)[:, None], la, 0.0) + np.where((y == k + 1)[:, None], lb, 0.0)))
    lin = la + lb
    for j in range(p):
        score[:, :, m + j] = -add(W * lin * X[:, j:j + 1])
    score[:, :, m + p] = -add(W * lin * Vr)
    mean = np.einsum("gq,gqi->gi", post, score)
    grad = mean.sum(axis=0)
    cov = np.einsum("gq,gqi,gqj->ij", post, score, score, optimize=True) - mean.T @ mean
    # expected complete-data Hessian
    H = np.zeros((n, n))
    both = aa + bb + 2 * ab
    s0, s1, s2 = (Q * both).sum(axis=1), (Q * both * Vr).sum(axis=1), float((Q * both * Vr * Vr).sum())
    H[m:m + p, m:m + p] = (X * s0[:, None]).T @ X
    H[m:m + p, m + p] = H[m + p, m:m + p] = X.T @ s1
    H[m + p, m + p] = s2
    ca, cb = (Q * (aa + ab)).sum(axis=1), (Q * (bb + ab)).sum(axis=1)
    va, vb = (Q * (aa + ab) * Vr).sum(axis=1), (Q * (bb + ab) * Vr).sum(axis=1)
    qa, qb, qab = ((Q * z).sum(axis=1) for z in (aa, bb, ab))
    for k in range(m):
        a, b = y == k, y == k + 1
        H[k, k] += qa[a].sum() + qb[b].sum()
        if k:
            H[k, k - 1] += qab[a].sum()  # class k lies between thresholds k - 1 and k
            H[k - 1, k] = H[k, k - 1]
        H[k, m:m + p] = -(X[a].T @ ca[a] + X[b].T @ cb[b])
        H[m:m + p, k] = H[k, m:m + p]
        H[k, m + p] = H[m + p, k] = -(va[a].sum() + vb[b].sum())
    return total, grad, H + cov


def _evaluating(p: int, k: int, asked: Sequence[tuple[int, int, tuple]], nodes: int):
    t, weight = np.polynomial.hermite.hermgauss(nodes)
    lw = np.log(weight) - 0.5 * math.log(math.pi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            held, size = [], 0
            for x, y, w in zip(*(b.column(c).to_pylist() for c in ("x", "y", "w"))):
                w = np.frombuffer(w)
                held.append((np.frombuffer(x).reshape(len(w), p), np.frombuffer(y, np.int32).reshape(len(w), k), w))
                size += len(w) * nodes
                if size > CELLS:
                    take(held, sums)
                    held, size = [], 0
            if held:
                take(held, sums)
        cols = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["at", "v"])

    def take(held: list, sums: dict) -> None:
        X, Y, w = (np.concatenate([h[i] for h in held]) for i in range(3))
        of = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        for at, (r, K, psi) in enumerate(asked):
            ok = Y[:, r] >= 0
            if not ok.any():
                continue
            starts = np.flatnonzero(np.diff(of[ok], prepend=-1))
            ll, g, H = _group_terms(X[ok], Y[ok, r], w[ok], starts, np.array(psi), K, t, lw)
            part = np.concatenate([[ll], g, H.ravel()])
            sums[at] = part if at not in sums else sums[at] + part

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for at, v in zip(b.column("at").to_pylist(), b.column("v").to_pylist()):
            x = np.frombuffer(v)
            sums[at] = x if at not in sums else sums[at] + x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                     names=["at", "v"])


@dataclass
class Point:
    psi: np.ndarray  # thresholds, coefficients, sigma
    loglik: float
    grad: np.ndarray
    hess: np.ndarray


def evaluate(st: OrdinalStats, asked: Mapping[int, Sequence[float]]) -> dict[int, Point]:
    """Log-likelihood, gradient and Hessian of all asked responses, in one
    job; the driver receives one array of the parameters' size for each."""
    order = [(r, st.classes[r], tuple(float(x) for x in psi)) for r, psi in asked.items()]
    schema = "at int, v binary"
    parts = st.groups.mapInArrow(_evaluating(len(st.names), len(st.responses), order, st.nodes), schema)
    got = {r["at"]: np.frombuffer(r["v"]) for r in parts.repartition("at").mapInArrow(_added, schema).collect()}
    out = {}
    for at, (r, _, psi) in enumerate(order):
        n, v = len(psi), got[at]
        out[r] = Point(np.array(psi), float(v[0]), v[1:1 + n], v[1 + n:].reshape(n, n))
    return out


# ------------------------------------------------------------------ fit
@dataclass
class OrdinalFit:
    response: str
    thresholds: np.ndarray
    beta: np.ndarray
    sigma: float
    loglik: float
    cov: np.ndarray  # of the coefficients
    names: list[str]
    n_classes: int
    converged: bool
    evaluations: int


def _start(shares: np.ndarray, p: int) -> np.ndarray:
    """Thresholds at the logits of the cumulative class shares, no effects."""
    cum = np.cumsum(shares + 0.5)
    cum = cum / cum[-1]
    return np.concatenate([np.log(cum[:-1] / (1 - cum[:-1])), np.zeros(p), [0.5]])


def fit_all(st: OrdinalStats, most: int = MAX_EVALUATIONS) -> dict[str, OrdinalFit]:
    """Maximum likelihood fits of all responses, by damped Newton steps
    that share their jobs."""
    p = len(st.names)
    ids = range(len(st.responses))
    best = evaluate(st, {r: _start(st.shares[r], p) for r in ids})
    damp, used, done = dict.fromkeys(ids, 0.0), dict.fromkeys(ids, 1), {}
    while len(done) < len(ids):
        tries = {}
        for r in ids:
            if r in done:
                continue
            b, m = best[r], st.classes[r] - 1
            vals, vecs = np.linalg.eigh(-b.hess)
            scale = max(np.abs(vals).max(), 1e-12)
            step = vecs @ ((vecs.T @ b.grad) / (np.maximum(np.abs(vals), 1e-9 * scale) + damp[r]))
            if abs(float(b.grad @ step)) < 1e-9 * (1 + abs(b.loglik)) * 1e-2 and vals.min() > -1e-6 * scale:
                done[r] = True
                continue
            for _ in range(40):  # thresholds stay in order
                if np.all(np.diff((b.psi + step)[:m]) > 0):
                    break
                step = step / 2
            if used[r] >= most or damp[r] > 1e12 * scale:
                done[r] = False
            else:
                tries[r] = b.psi + step
        if not tries:
            break
        for r, new in evaluate(st, tries).items():
            used[r] += 1
            scale = max(np.abs(best[r].hess).max(), 1e-12)
            if np.isfinite(new.loglik) and new.loglik >= best[r].loglik - 1e-12 * abs(best[r].loglik):
                best[r], damp[r] = new, (damp[r] / 10 if damp[r] > 1e-9 * scale else 0.0)
            else:
                damp[r] = max(10 * damp[r], 1e-4 * scale)
    out = {}
    for r, y in enumerate(st.responses):
        b, m = best[r], st.classes[r] - 1
        cov = np.linalg.pinv(-b.hess)
        out[y] = OrdinalFit(y, b.psi[:m], b.psi[m:m + p], abs(float(b.psi[-1])), b.loglik, cov[m:m + p, m:m + p], st.names,
                            st.classes[r], done[r], used[r])
    return out


def fit_ordinal_mixed(df: DataFrame, y: str, design: Design, group: str, n_classes: int, nodes: int = NODES,
                      most: int = MAX_EVALUATIONS) -> OrdinalFit:
    """J7 for one response."""
    return fit_all(ordinal_stats(df, y, design, group, n_classes, nodes), most)[y]


def ordinal_table(spark, fits: OrdinalFit | Mapping[str, OrdinalFit], dv: str | None = None) -> DataFrame:
    """J7 result rows: thresholds, coefficients with Wald z and p, sigma, logL;
    every row says whether its fit converged and after how many evaluations."""
    named = {dv or fits.response: fits} if isinstance(fits, OrdinalFit) else fits
    rows = []
    for name, fit in named.items():
        tail = (bool(fit.converged), int(fit.evaluations))
        rows += [(name, f"{k}|{k + 1}", "threshold", float(t), None, None, None, *tail) for k, t in enumerate(fit.thresholds)]
        for j, n in enumerate(fit.names):
            se = float(math.sqrt(max(fit.cov[j, j], 0.0)))
            z = float(fit.beta[j] / se) if se > 0 else float("nan")
            rows.append((name, n, "coefficient", float(fit.beta[j]), se, z, tails.normal_two_sided(z), *tail))
        rows.append((name, "sigma_group", "random", float(fit.sigma), None, None, None, *tail))
        rows.append((name, "logLik", "fit", float(fit.loglik), None, None, None, *tail))
    return spark.createDataFrame(rows, "dv string, term string, kind string, estimate double, std_err double, "
                                       "z double, p_value double, converged boolean, evaluations int")
