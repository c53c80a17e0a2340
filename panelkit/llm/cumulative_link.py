"""Cumulative-link (proportional-odds) ordinal regression on hashed text.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector shared by all ordered
thresholds theta_1 < ... < theta_{K-1}. Features are hashed into ``DIM``
buckets with CRC-32, so every worker agrees on them.

Fitting takes a bounded sample of labelled rows: the ``max_rows`` ids with the
least hash, so it is the same sample in every run. Features are made on the
executors; at most ``max_rows`` sparse vectors of at most ``DIM`` entries reach
the driver, where L-BFGS runs in numpy. Scoring is one pass over all rows with
the fitted weights (DIM floats) broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 1 << 17
MAX_ROWS = 6000
L2 = 1e-4
#: Rows of the sample a bucket must occur in to get a weight.
MIN_ROWS = 10
ITERATIONS = 80


class Features(NamedTuple):
    """Units of a text with their values, and the feature names a unit stands
    for; every name of a unit gets the value of the unit."""

    units: Callable[[str], dict[str, float]]
    names: Callable[[str], list[str]] = lambda unit: [unit]


class Model(NamedTuple):
    weights: np.ndarray  # DIM
    thresholds: np.ndarray  # K - 1, increasing


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % DIM


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, float)))


def tails(eta, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. K-1; one row per eta."""
    return sigmoid(np.asarray(eta, float)[:, None] - thresholds[None, :])


def _unpack(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds: the first, then positive steps."""
    return p[:-(k - 1)], np.cumsum(np.concatenate((p[-(k - 1):][:1], np.exp(p[-(k - 1):][1:]))))


def loss_gradient(p: np.ndarray, row: np.ndarray, ids: np.ndarray, vals: np.ndarray, y: np.ndarray, k: int,
                  l2: float = L2) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood plus ridge, and its gradient. (row, ids,
    vals) are the entries of the sparse rows; y the grades 0 .. k-1."""
    w, theta = _unpack(p, k)
    n = len(y)
    eta = np.bincount(row, vals * w[ids], n)
    upper = np.concatenate((theta, [np.inf]))[y]
    lower = np.concatenate(([-np.inf], theta))[y]
    fu, fl = sigmoid(upper - eta), sigmoid(lower - eta)
    prob = np.maximum(fu - fl, 1e-12)
    du, dl = fu * (1 - fu) / prob, fl * (1 - fl) / prob
    g_eta = (du - dl) / n
    g_theta = np.array([(-du[y == j].sum() + dl[y == j + 1].sum()) / n for j in range(k - 1)])
    # theta_j = first + sum of steps up to j
    back = np.cumsum(g_theta[::-1])[::-1]
    g_p = np.concatenate((back[:1], back[1:] * np.exp(p[-(k - 1):][1:])))
    g_w = np.bincount(ids, vals * g_eta[row], len(w)) + l2 * w
    return float(-np.log(prob).mean() + 0.5 * l2 * (w @ w)), np.concatenate((g_w, g_p))


def lbfgs(fun, x: np.ndarray, iterations: int = ITERATIONS, memory: int = 8) -> np.ndarray:
    f, g = fun(x)
    steps: list = []
    for _ in range(iterations):
        q, alphas = g.copy(), []
        for s, z, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * z
        if steps:
            s, z, _ = steps[-1]
            q *= (s @ z) / (z @ z)
        for (s, z, rho), a in zip(steps, reversed(alphas)):
            q += (a - rho * (z @ q)) * s
        slope, step = -(g @ q), 1.0 if steps else 1.0 / max(1.0, float(np.abs(g).sum()))
        if slope >= 0:
            break
        for _ in range(30):
            new = x - step * q
            f_new, g_new = fun(new)
            if f_new <= f + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, z = new - x, g_new - g
        if s @ z > 1e-12:
            steps = (steps + [(s, z, 1.0 / (s @ z))])[-memory:]
        done = abs(f - f_new) <= 1e-8 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int, l2: float = L2, min_rows: int = MIN_ROWS) -> Model:
    """Fit (grade, ids, vals) rows; without rows a model whose thresholds are
    NaN. Buckets of fewer than ``min_rows`` rows keep weight zero."""
    if not rows:
        return Model(np.zeros(DIM), np.full(k - 1, np.nan))
    y = np.array([r[0] for r in rows])
    seen = np.zeros(DIM, np.int64)
    for _, ids, _ in rows:
        seen[ids] += 1  # the buckets of a row are distinct
    used = np.flatnonzero(seen >= min_rows)
    place = np.full(DIM, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = [place[ids] for _, ids, _ in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [int((k >= 0).sum()) for k in kept])
    vals = np.concatenate([r[2][k >= 0] for r, k in zip(rows, kept)]).astype(np.float32)
    ids = np.concatenate([k[k >= 0] for k in kept])
    share = np.clip([(y <= j).mean() for j in range(k - 1)], 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(theta), 1e-2))
    start = np.concatenate((np.zeros(len(used)), theta[:1], steps))
    w, theta = _unpack(lbfgs(lambda p: loss_gradient(p, row, ids, vals, y, k, l2), start), k)
    weights = np.zeros(DIM)
    weights[used] = w
    return Model(weights, theta)


def labelled_features(docs: DataFrame, grades: DataFrame, id_col: str, text_col: str, features: Features,
                      max_rows: int = MAX_ROWS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(grade, ids, vals) of the labelled sample. ``grades`` (id, grade); of
    several grades of one id the highest holds; nulls are no labels."""
    sample = (grades.where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # at most max_rows ids and grades: broadcast, so the texts are not shuffled
    met = slim.join(F.broadcast(sample), "id").select("id", "grade", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, grade, text in zip(pdf["id"], pdf["grade"], pdf["text"].fillna("")):
                made = hashed(text, features)
                out.append((i, grade, np.array(list(made), "<i4").tobytes(), np.array(list(made.values()), "<f4").tobytes()))
            yield pd.DataFrame(out, columns=["id", "grade", "ids", "vals"])

    # repeated rows of a sampled id could be many: one of them is enough
    found = met.mapInPandas(run, "id long, grade int, ids binary, vals binary").dropDuplicates(["id"])
    rows = sorted(found.collect(), key=lambda r: r["id"])
    return [(r["grade"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["vals"], "<f4")) for r in rows]


def hashed(text: str, features: Features) -> dict[int, float]:
    """Feature values by bucket; values that share a bucket add up."""
    out: dict[int, float] = {}
    for unit, value in features.units(text).items():
        for name in features.names(unit):
            b = bucket(name)
            out[b] = out.get(b, 0.0) + value
    return out


class Scorer:
    """eta = w.x of whole texts, remembering the weight of known units."""

    CACHE = 1_000_000

    def __init__(self, weights: np.ndarray, features: Features):
        self.weights, self.features, self.known = weights, features, {}

    def eta(self, text: str) -> float:
        known, total = self.known, 0.0
        if len(known) > self.CACHE:
            known.clear()
        units, names = self.features
        for unit, value in units(text).items():
            w = known.get(unit)
            if w is None:
                w = known[unit] = sum(float(self.weights[bucket(n)]) for n in names(unit))
            if w:
                total += w * value
        return total


def score_udf(spark: SparkSession, model: Model, features: Features):
    """Column function: text -> array of P(grade >= k), k = 1 .. K-1; null
    under a model fitted without any label."""
    weights, thresholds = spark.sparkContext.broadcast(model.weights.astype(np.float32)), model.thresholds

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(weights.value, features)
        for texts in batches:
            if np.isnan(thresholds).any():
                yield pd.Series([None] * len(texts), dtype=object)
                continue
            eta = np.array([scorer.eta(t) for t in texts.fillna("")])
            yield pd.Series(list(tails(eta, thresholds)), dtype=object)

    return run
