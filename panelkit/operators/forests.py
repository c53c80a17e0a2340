"""Bagged forests on counted rows.

Trees see an ordered feature only through the bins between its cut points.
Rows that share all bins (a cell) are bagged once, row by row or by their
number, and every level of all trees is one job over the cells: tasks send
histograms, one group per tree chooses the splits, and only splits (model-sized)
reach the driver. Split rules are MLlib's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import materialize

#: Rows that are bagged at a time.
_BAG_ROWS = 2_000


def _impurity(stats: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of rows, impurity) of class counts or of (n, sum, sum of squares)."""
    if classes:
        n = stats.sum(axis=-1)
        some = np.maximum(n, 1)
        return n, np.where(n > 0, 1 - ((stats / some[..., None]) ** 2).sum(axis=-1), 0.0)
    n = stats[..., 0]
    some = np.maximum(n, 1)
    return n, np.where(n > 0, stats[..., 2] / some - (stats[..., 1] / some) ** 2, 0.0)


def _best_split(hist: np.ndarray, start: np.ndarray, among: np.ndarray, classes: int):
    """(gain, feature, bin, left stats, right stats) of the best split of a
    node's histogram (bins of all features x stats), or None."""
    best = None
    for f in among:
        h = hist[start[f]:start[f + 1]]
        upto = h.cumsum(axis=0)
        total, left = upto[-1], upto[:-1]
        if not len(left):
            continue
        right = total - left
        (n, i), (nl, il), (nr, ir) = (_impurity(s, classes) for s in (total, left, right))
        gain = np.where((nl > 0) & (nr > 0), i - (nl * il + nr * ir) / max(n, 1), -np.inf)
        at = int(gain.argmax())
        if gain[at] > 0 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), int(f), at, left[at], right[at])
    return best


def _votes(x: np.ndarray, splits: list, of: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """Summed leaf values of all trees (:meth:`CountedForest._tables`), rows x outputs."""
    above = np.array([~(x[:, f] <= cut) for f, cut in splits] + [np.zeros(len(x), bool)]).astype(np.intp).ravel()
    out, row = np.zeros((len(x), lowest.shape[2])), np.arange(len(x))
    depth = (of.shape[1] + 1).bit_length() - 1
    for t in range(len(of)):
        node, base = np.zeros(len(x), np.intp), of[t] * len(x)
        for _ in range(depth):
            node = 2 * node + 1 + above[base[node] + row]
        out += lowest[t][node - of.shape[1]]
    return out


@dataclass
class _Tree:
    featureImportances: DenseVector  # noqa: N815


@dataclass
class CountedForest:
    """A forest in heap order (children of node i: 2i + 1, 2i + 2), arrays of
    trees x nodes: feature (-1 at leaves), bin (codes up to it go left), gain
    and the stats of the bagged rows. ``classes`` is 0 for regression."""

    cuts: list
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    stats: np.ndarray
    classes: int
    features: str

    def importances(self, tree: int) -> np.ndarray:
        """Gain times rows per feature of one tree, adding up to 1."""
        split = self.feature[tree] >= 0
        n, _ = _impurity(self.stats[tree][split], self.classes)
        got = np.bincount(self.feature[tree][split], self.gain[tree][split] * n, len(self.cuts))
        return got / got.sum() if got.sum() > 0 else got

    @property
    def trees(self) -> list:
        return [_Tree(DenseVector(self.importances(t))) for t in range(len(self.feature))]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        got = sum(self.importances(t) for t in range(len(self.feature)))
        return DenseVector(got / got.sum() if got.sum() > 0 else got)

    def values(self) -> np.ndarray:
        """Trees x nodes x outputs: class shares, or the mean."""
        n, _ = _impurity(self.stats, self.classes)
        return (self.stats if self.classes else self.stats[..., 1:2]) / np.maximum(n, 1)[..., None]

    def node_rows(self) -> list[list]:
        """Rows of ``models.NODE_SCHEMA``, nodes numbered from the root down, left first."""
        rows: list[list] = []
        n, _ = _impurity(self.stats, self.classes)
        values = self.values()
        best = values.argmax(axis=-1) if self.classes else values[..., 0]

        def walk(t: int, i: int, depth: int, part: list) -> int:
            f, my = int(self.feature[t, i]), len(part)
            cut = self.cuts[f][int(self.bin[t, i])] if f >= 0 else None
            rec = [t, my, f, cut, float(self.gain[t, i]) if f >= 0 else 0.0, float(n[t, i]), float(best[t, i]), -1, -1, depth, None, 1.0 / len(self.feature)]
            part.append(rec)
            if f >= 0:
                rec[7], rec[8] = walk(t, 2 * i + 1, depth + 1, part), walk(t, 2 * i + 2, depth + 1, part)
            return my

        for t in range(len(self.feature)):
            part: list[list] = []
            walk(t, 0, 0, part)
            rows += part
        return rows

    def _tables(self):
        """(feature, cut) of the distinct splits; trees x inner nodes: number of
        the node's split, one past the last at leaves, whose rows all go on
        left; values of the lowest nodes."""
        inner = self.feature.shape[1] // 2
        pairs = sorted({(int(f), int(b)) for f, b in zip(self.feature.ravel(), self.bin.ravel()) if f >= 0})
        number = {p: i for i, p in enumerate(pairs)}
        of = np.array([[number.get((int(f), int(b)), len(pairs)) for f, b in zip(fs, bs)] for fs, bs in zip(self.feature[:, :inner], self.bin[:, :inner])])
        values = self.values()
        for i in range(inner):
            leaf = self.feature[:, i] < 0
            values[leaf, 2 * i + 1] = values[leaf, i]
        return [(f, self.cuts[f][b]) for f, b in pairs], of.reshape(len(self.feature), inner), values[:, inner:]

    def predictions(self, x: np.ndarray) -> np.ndarray:
        """Of a regression forest, for rows of features."""
        tables = self._tables()
        return np.concatenate([_votes(x[at:at + _BAG_ROWS], *tables)[:, 0] for at in range(0, len(x), _BAG_ROWS)]) / float(len(self.feature))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, for classes also ``rawPrediction`` and ``probability``."""
        shared = df.sparkSession.sparkContext.broadcast(self._tables())

        @F.pandas_udf("array<double>")
        def votes(x: pd.Series) -> pd.Series:
            return pd.Series(list(_votes(np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1)), *shared.value)))

        out = df.withColumn("__votes", votes(vector_to_array(self.features)))
        trees = F.lit(float(len(self.feature)))
        if not self.classes:
            return out.withColumn("prediction", F.col("__votes")[0] / trees).drop("__votes")
        raw = array_to_vector(F.col("__votes"))
        share = array_to_vector(F.transform("__votes", lambda v: v / trees))
        first = (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double")
        return out.withColumns({"rawPrediction": raw, "probability": share, "prediction": first}).drop("__votes")


def _list_rows(column: pa.Array, dtype, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(rows, -1)


def _bagged(counted: DataFrame, trees: int, classes: int, seed: int) -> DataFrame:
    """Cells (codes, bag) from rows (__codes, __y, __m) sorted by cell and
    response: per tree the stats of Poisson(1) copies of each of the __m rows.
    Draws are named by the first row of their batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BAG_ROWS):
                b = whole.slice(at, _BAG_ROWS)
                codes = _list_rows(b.column(0), np.int16, b.num_rows)
                y, m = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                rng = np.random.default_rng([seed, zlib.crc32(codes[0].tobytes() + np.float64(y[0]).tobytes())])
                copies = rng.poisson(m[:, None].astype(float), (b.num_rows, trees)).astype(float)
                first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
                parts = [copies * (y == c)[:, None] for c in range(classes)] if classes else [copies, copies * y[:, None], copies * (y * y)[:, None]]
                bag = np.stack([np.add.reduceat(p, first, axis=0) for p in parts], axis=2)
                kept = pa.array([c.tobytes() for c in codes[first]], pa.binary())
                yield pa.RecordBatch.from_arrays([kept, pa.array([x.tobytes() for x in bag], pa.binary())], ["codes", "bag"])

    return counted.select("__codes", "__y", "__m").mapInArrow(run, "codes binary, bag binary")


def _level(cells: DataFrame, shared, level: int, start: np.ndarray, mtry: int, classes: int, seed: int) -> DataFrame:
    """The splits of all live nodes of a level: tasks add up the bags of their
    cells per (tree, node, feature, bin), a tree's histograms meet in one group."""
    first, here, k = (1 << level) - 1, 1 << level, classes or 3
    features = len(start) - 1

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, at, live = shared.value
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            codes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int16).reshape(n, -1)
            bag = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(n, len(live), k)
            slots, row, ids, out = codes + start[:-1], np.arange(n), [], []
            for t in range(len(live)):
                if not live[t, first:first + here].any():
                    continue
                node = np.zeros(n, np.intp)
                for _ in range(level):  # rows of a leaf stay there
                    f = feature[t, node]
                    node = np.where(f >= 0, 2 * node + 1 + (codes[row, f] > at[t, node]), node)
                use = live[t, node] & (node >= first)
                cell = ((node[use] - first)[:, None] * start[-1] + slots[use]).ravel()
                w = bag[use, t]
                hist = [np.bincount(cell, np.repeat(w[:, j], features), here * start[-1]) for j in range(k)]
                ids.append(t)
                out.append(np.stack(hist, axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], ["tree", "hist"])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        t, live = int(part["tree"].iloc[0]), shared.value[2]
        hist = sum(np.frombuffer(h) for h in part["hist"]).reshape(here, start[-1], k)
        found = []
        for i in np.flatnonzero(live[t, first:first + here]):
            among = np.sort(np.random.default_rng([seed, t, first + int(i)]).choice(features, mtry, replace=False))
            total = hist[i, :start[1]].sum(axis=0)
            best = _best_split(hist[i], start, among, classes) if _impurity(total, classes)[1] > 0 else None
            g, f, b, left, right = best or (0.0, -1, 0, total * 0, total * 0)
            found.append((t, first + int(i), f, b, g, total.tolist(), left.tolist(), right.tolist()))
        return pd.DataFrame(found, columns=["tree", "node", "feature", "bin", "gain", "total", "left", "right"])

    sent = cells.mapInArrow(histograms, "tree int, hist binary")
    return sent.groupBy("tree").applyInPandas(choose, "tree int, node int, feature int, bin int, gain double, "
                                              "total array<double>, left array<double>, right array<double>")


def grow(counted: DataFrame, rows: int, cuts: list, trees: int, depth: int, mtry: int, classes: int, seed: int, features: str) -> CountedForest:
    """Grow ``trees`` trees of ``depth`` levels from rows (__codes, __y, __m),
    all levels of one height in one job; ``mtry`` features are tried per node."""
    spark, cores = counted.sparkSession, counted.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, rows // 1_000_000)
    ordered = counted.repartitionByRange(parts, "__codes", "__y").sortWithinPartitions("__codes", "__y")
    cells = materialize(_bagged(ordered, trees, classes, seed))
    width, k = [len(c) + 1 for c in cuts], classes or 3
    start = np.r_[0, np.cumsum(width)]
    nodes = (1 << (depth + 1)) - 1
    feature, at = np.full((trees, nodes), -1), np.zeros((trees, nodes), int)
    gain, stats = np.zeros((trees, nodes)), np.zeros((trees, nodes, k))
    live = np.zeros((trees, nodes), bool)
    live[:, 0] = True
    for level in range(depth):
        first, here = (1 << level) - 1, 1 << level
        if not live[:, first:first + here].any():
            break
        shared = spark.sparkContext.broadcast((feature.copy(), at.copy(), live.copy()))
        chosen = _level(cells, shared, level, start, mtry, classes, seed)
        for r in chosen.collect():  # one row per node of the level
            t, i = r["tree"], r["node"]
            feature[t, i], at[t, i], gain[t, i], stats[t, i] = r["feature"], r["bin"], r["gain"], r["total"]
            if r["feature"] >= 0:
                for child, s in ((2 * i + 1, r["left"]), (2 * i + 2, r["right"])):
                    stats[t, child] = s
                    live[t, child] = level + 1 < depth and _impurity(np.array(s), classes)[1] > 0
        shared.unpersist()
    return CountedForest(cuts, feature, at, gain, stats, classes, features)
