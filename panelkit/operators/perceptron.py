"""Multilayer perceptrons on packed rows.

The loss that MLlib's ``MultilayerPerceptronClassifier`` minimizes (sigmoid
hidden units, softmax, mean cross entropy) with the optimizer that it uses (L-BFGS
with a strong Wolfe line search) and its layout of the weights. Rows are packed
once into blocks of columns; an evaluation is one job over them in which a task
sends the sums of its rows, one model in size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import materialize

#: Rows per packed record, and rows that meet the weights at a time (their activations stay in a core's cache).
PACK_ROWS, BLOCK_ROWS = 8_192, 1_024
#: Rows per task; a task has one record of sums.
TASK_ROWS = 250_000


def pack(df: DataFrame, features: str, label: str, sizes: Sequence[int], rows: int) -> DataFrame:
    """Records (n, x, y, bad) of up to ``PACK_ROWS`` rows. A column that holds only
    small whole numbers in a record takes a byte per row, others eight; a label
    that is no class is -1. ``bad``: rows with such a label or a value that is not finite."""
    width, classes = sizes[0], sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PACK_ROWS):
                b = whole.slice(at, PACK_ROWS)
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width).T
                y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
                with np.errstate(invalid="ignore"):
                    small = [bool((np.abs(c) <= 127).all() and (c == np.rint(c)).all()) for c in x]
                    known = (y >= 0) & (y < classes) & (y == np.floor(y))
                bad = int((~(np.isfinite(x).all(axis=0) & known)).sum())
                data = bytes(small) + b"".join(c.astype(np.int8 if s else np.float64).tobytes() for c, s in zip(x, small))
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.array([data], pa.binary()),
                                                  pa.array([np.where(known, y, -1).astype(np.int16).tobytes()], pa.binary()), pa.array([bad], pa.int32())],
                                                 ["n", "x", "y", "bad"])

    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    slim = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return materialize(slim.repartition(tasks).mapInArrow(run, "n int, x binary, y binary, bad int")).persist()


def _unpacked(n: int, x: bytes, y: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns and a line of ones, classes)."""
    out, at = np.ones((width + 1, n)), width
    for j in range(width):
        kind = np.int8 if x[j] else np.float64
        out[j] = np.frombuffer(x, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out, np.frombuffer(y, np.int16).astype(np.intp)


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Views (inputs and bias x outputs) per layer of one flat vector."""
    out, at = [], 0
    for i, o in zip(sizes, sizes[1:]):
        out.append(weights[at:at + (i + 1) * o].reshape(i + 1, o))
        at += (i + 1) * o
    return out


def _rows_of(x: np.ndarray, y: np.ndarray, net: list, grads: list | None, confusion: np.ndarray) -> float:
    """Add the gradients of rows to ``grads`` (None: none are wanted) and their
    cells to the confusion (true, one past the last for other labels; predicted);
    their summed loss. Rows lie in columns; the last line of x, as of all
    activations, is 1 and meets the bias. Hidden weights of ``net`` are negated."""
    acts = [x]
    for w in net[:-1]:
        z = np.empty((w.shape[1] + 1, len(y)))
        z[-1], h = 1, z[:-1]
        np.matmul(w.T, acts[-1], out=h)
        np.exp(h, out=h)
        h += 1
        np.reciprocal(h, out=h)
        acts.append(z)
    z = net[-1].T @ acts[-1]
    classes = len(z)
    known = (y >= 0) & (y < classes)
    confusion += np.bincount(np.where(known, y, classes) * classes + z.argmax(axis=0), minlength=confusion.size).reshape(confusion.shape)
    if grads is None:
        return 0.0
    row = np.arange(len(y))
    z -= z.max(axis=0)
    right = z[y, row]
    np.exp(z, out=z)
    total = z.sum(axis=0)
    z /= total
    z[y, row] -= 1
    delta = z
    for k in range(len(net) - 1, -1, -1):
        grads[k] += acts[k] @ delta.T
        if k:
            h = acts[k][:-1]
            delta = (net[k][:-1] if k == len(net) - 1 else -net[k][:-1]) @ delta
            delta *= h
            np.subtract(1, h, out=h)
            delta *= h
    return float((np.log(total) - right).sum())


def evaluate(packed: DataFrame, weights: np.ndarray, sizes: Sequence[int], gradient: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean loss, its gradient, confusion counts) over all packed rows."""
    sizes, k = list(sizes), sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, grad, confusion, loss, rows = _layers(weights, sizes), np.zeros(len(weights)), np.zeros((k + 1, k), np.int64), 0.0, 0
        net = [-w for w in net[:-1]] + net[-1:]
        grads = _layers(grad, sizes) if gradient else None
        with np.errstate(over="ignore", invalid="ignore"):
            for b in batches:
                for n, x, y in zip(*(c.to_pylist() for c in b.columns[:3])):
                    x, y = _unpacked(n, x, y, sizes[0])
                    for at in range(0, n, BLOCK_ROWS):
                        loss += _rows_of(x[:, at:at + BLOCK_ROWS], y[at:at + BLOCK_ROWS], net, grads, confusion)
                    rows += n
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([loss]), pa.array([grad.tobytes() if gradient else b""], pa.binary()),
                                          pa.array([confusion.tobytes()], pa.binary())], ["n", "loss", "grad", "confusion"])

    got = packed.select("n", "x", "y").mapInArrow(run, "n long, loss double, grad binary, confusion binary").collect()  # one row per task
    n = max(sum(r["n"] for r in got), 1)
    grad = sum(np.frombuffer(r["grad"]) for r in got) / n if gradient else np.zeros(0)
    return math.fsum(r["loss"] for r in got) / n, grad, sum(np.frombuffer(r["confusion"], np.int64) for r in got).reshape(k + 1, k)


def macro_scores(confusion: np.ndarray) -> tuple[float | None, float | None]:
    """Accuracy and macro F1 as ``metrics.macro_scores`` has them."""
    k = confusion.shape[1]
    tp, predicted, support = confusion[range(k), range(k)], confusion.sum(axis=0), confusion[:k].sum(axis=1)
    present = predicted + support > 0  # tp + fp + fn > 0
    f1 = 2 * tp[present] / (predicted + support)[present]
    return (tp.sum() / support.sum() if support.sum() else None), (f1.mean() if present.any() else None)


# ------------------------------------------------------------------ L-BFGS
class _SearchFailed(Exception):
    pass


def _between(a: tuple, b: tuple) -> float:
    """Minimum of the cubic through two brackets (t, value, slope), kept off their ends."""
    (lt, lv, ld), (rt, rv, rd) = (a, b) if a[0] <= b[0] else (b, a)
    d1 = ld + rd - 3 * (lv - rv) / (lt - rt)
    root = d1 * d1 - ld * rd
    d2 = math.sqrt(root) if root >= 0 else math.nan
    bottom = rd - ld + 2 * d2
    t = rt - (rt - lt) * (rd + d2 - d1) / bottom if bottom else math.nan
    least, most = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return least if t < least else most if t > most else t


def _strong_wolfe(phi: Callable[[float], tuple], start: tuple, t: float, c1: float = 1e-4, c2: float = 0.9, tries: int = 10) -> float:
    """Step length by bracketing and zooming; ``phi``: bracket of a step."""
    _, value, slope = low = start
    if slope > 0:
        raise _SearchFailed

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(tries):
            c = phi(_between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _SearchFailed

    for i in range(tries):
        c = phi(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise _SearchFailed


def _direction(grad: np.ndarray, steps: list, changes: list) -> np.ndarray:
    """Two-loop recursion, newest pair first."""
    scale = 1.0
    if steps:
        sy = steps[0] @ changes[0]
        if not sy >= 0:
            raise _SearchFailed
        scale = sy / (changes[0] @ changes[0])
    d, alphas, rhos = grad.copy(), [], [s @ y for s, y in zip(steps, changes)]
    for s, y, rho in zip(steps, changes, rhos):
        if rho < 0 or math.isnan(rho):
            raise _SearchFailed
        alphas.append((s @ d) / rho)
        d -= alphas[-1] * y
    d *= scale
    for s, y, rho, a in reversed(list(zip(steps, changes, rhos, alphas))):
        d += (a - (y @ d) / rho) * s
    return -d


def lbfgs(f: Callable[[np.ndarray], tuple], x: np.ndarray, iterations: int, pairs: int = 10, tol: float = 1e-6, values: int = 20) -> tuple[np.ndarray, list[float], tuple]:
    """Minimize ``f``: x -> (value, gradient, ...). Returns x, the value of every
    iteration from the start on, and what ``f`` said at x. A failed line search
    drops the pairs once, a second one in a row ends the search."""
    got = f(x)
    value, grad = first, _ = got[:2]
    history, seen, steps, changes, failed, done = [value], [math.inf], [], [], False, 0
    while done < iterations and np.linalg.norm(grad) > max(tol * value, 1e-8) and not (
            len(seen) > 1 and abs(value - max(seen)) <= tol * first):
        last: dict = {}
        try:
            d = _direction(grad, steps, changes)

            def phi(t: float) -> tuple:
                last.clear()
                last[t] = f(x + t * d)  # noqa: B023
                return t, last[t][0], float(last[t][1] @ d)  # noqa: B023

            t = _strong_wolfe(phi, (0.0, value, float(grad @ d)), 1.0 if done else 1 / np.linalg.norm(d))
            if t * np.linalg.norm(grad) < 1e-10:
                raise _SearchFailed
        except _SearchFailed:
            if failed:
                break
            failed, steps, changes = True, [], []
            history.append(value)
            continue
        got = last[t] if t in last else f(x + t * d)
        steps, changes = [t * d, *steps][:pairs], [got[1] - grad, *changes][:pairs]
        x, (value, grad), failed, done = x + t * d, got[:2], False, done + 1
        seen = [*seen, value][-values:]
        history.append(value)
    return x, history, got


def train(packed: DataFrame, weights: np.ndarray, sizes: Sequence[int], iterations: int) -> tuple[np.ndarray, list[float], np.ndarray]:
    """(weights, loss of every iteration from the start on, confusion of the
    training rows) after ``iterations`` of L-BFGS."""
    weights, losses, got = lbfgs(lambda w: evaluate(packed, w, sizes), weights, iterations)
    return weights, losses, got[2]
