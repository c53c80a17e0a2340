"""Model training, scoring and model tables on Spark MLlib (survey K1-K10,
A8, D19, L1).

Feature preparation (B15 scaler + B22 drop-first one-hot, fitted on train)
is our expression encoders followed by ``VectorAssembler``; learners are MLlib
estimators with named presets. Tree internals are read once from the fitted
model (driver-side, model-sized) into flat node tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators import clean, encode, forests, metrics, perceptron, ranks
from panelkit.session import materialize


# ------------------------------------------------------------------ feature preparation
@dataclass
class Prep:
    numeric: list[str]
    levels: dict[str, list]
    stats: DataFrame | None
    scale: bool
    mode: str = "one_hot"  # or "codes": native categorical features for the tree learners

    @property
    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        for c, lvs in self.levels.items():
            names += [c] if self.mode == "codes" else [f"{c}_{lv}" for lv in lvs[1:]]
        return names

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        d = clean.apply_scaler(df, self.stats, self.numeric) if self.scale and self.numeric else df
        if self.mode == "codes":
            # code = sorted-level position, unseen level -> an extra last category (K2 native categoricals)
            d = encode.codes(d, self.levels, unseen=-1, suffix="__code")
            for c, lvs in self.levels.items():
                d = d.withColumn(f"{c}__code", F.when(F.col(f"{c}__code") < 0, len(lvs))
                                 .otherwise(F.col(f"{c}__code")))
            cols = [F.col(c).cast("double") for c in self.numeric] + [F.col(f"{c}__code").cast("double")
                                                                       for c in self.levels]
        else:
            d = encode.one_hot(d, self.levels, drop="first", keep_input=True)
            cols = [F.col(f"`{c}`").cast("double") for c in self.feature_names]
        d = d.select("*", *[F.coalesce(c, F.lit(0.0)).alias(f"__v{i}") for i, c in enumerate(cols)])
        asm = VectorAssembler(inputCols=[f"__v{i}" for i in range(len(cols))], outputCol=out, handleInvalid="keep")
        res = asm.transform(d).drop(*[f"__v{i}" for i in range(len(cols))])
        if self.mode == "codes":
            res = res.drop(*[f"{c}__code" for c in self.levels])
            res = res.withColumn(out, F.col(out).alias(out, metadata=self._ml_attrs()))
        return res

    def _ml_attrs(self) -> dict:
        """Feature metadata marking the coded columns as nominal, so MLlib trees
        split them as categories."""
        numeric = [{"idx": i, "name": n} for i, n in enumerate(self.numeric)]
        nominal = [{"idx": len(self.numeric) + j, "name": c, "vals": [str(v) for v in lvs] + ["__unseen__"]}
                   for j, (c, lvs) in enumerate(self.levels.items())]
        attrs = {"numeric": numeric} if numeric else {}
        if nominal:
            attrs["nominal"] = nominal
        return {"ml_attr": {"attrs": attrs, "num_attrs": len(numeric) + len(nominal)}}


def fit_prep(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True,
             mode: str = "one_hot") -> Prep:
    """B15 + B22 (``mode='one_hot'``) or native coded categoricals
    (``mode='codes'``, K2), fitted on the training rows only."""
    levels = encode.fit_levels(train, list(categorical)) if categorical else {}
    stats = materialize(clean.fit_scaler(train, list(numeric))) if scale and numeric else None  # one row, not one pass per use
    return Prep(list(numeric), levels, stats, scale, mode)


# ------------------------------------------------------------------ learners
PRESETS = {
    # forests (K1): 100 trees as in the model comparison, 300 as in the importance study
    "forest": lambda: RandomForestRegressor(numTrees=100, seed=42),
    "forest300": lambda: RandomForestRegressor(numTrees=300, seed=42),
    # boosted presets (K2): library defaults / 300 trees / 400 trees of depth 4
    "boost": lambda: GBTRegressor(maxIter=100, maxDepth=6, stepSize=0.1, seed=42),
    "boost300": lambda: GBTRegressor(maxIter=300, maxDepth=6, stepSize=0.1, seed=42),
    "boost400d4": lambda: GBTRegressor(maxIter=400, maxDepth=4, stepSize=0.1, seed=42),
    # classifiers
    "forest_classifier300": lambda: RandomForestClassifier(numTrees=300, seed=42),
    "tree_classifier_d4": lambda: DecisionTreeClassifier(maxDepth=4, seed=42),
}


def learner(preset: str, label: str = "label", features: str = "features", **overrides):
    est = PRESETS[preset]()
    est = est.setLabelCol(label).setFeaturesCol(features)
    for k, v in overrides.items():
        est = est._set(**{k: v})
    return est


# ------------------------------------------------------------------ boosting on counted rows
#: Rows that place the cut points, as many as MLlib's own tree learners take.
EDGE_ROWS = 10_000
#: Rows up to which boosted trees are fitted on the rows themselves.
PLAIN_ROWS = 50_000
#: Counted rows per task; tables of more than a million per core have larger tasks.
CELL_ROWS = 20_000


def _edges(values: np.ndarray, weights: np.ndarray, splits: int) -> list[float]:
    """Cut points of one ordered feature by MLlib's rule: between all distinct
    values while they are few, else where the running weight is nearest to the
    next multiple of an equal share."""
    v, at = np.unique(values, return_inverse=True)
    if len(v) - 1 <= splits:
        return ((v[:-1] + v[1:]) / 2).tolist()
    w = np.bincount(at.ravel(), weights)
    upto, step, out = np.cumsum(w), float(w.sum()) / (splits + 1), []
    target = step
    for i in range(1, len(v)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(float(v[i - 1] + v[i]) / 2)
            target += step
    return out


def bin_edges(train: DataFrame, features: str, max_bins: int, weight: str | None = None, seed: int = 42) -> list[list[float] | None]:
    """Per feature its cut points, from all rows or a sample of ``EDGE_ROWS``;
    None for a nominal feature."""
    nominal = {a["idx"] for a in train.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])}
    rows = train.select(vector_to_array(features).alias("x"), F.col(weight).cast("double").alias("w") if weight else F.lit(1.0).alias("w"))
    n, need = rows.count(), max(max_bins ** 2, EDGE_ROWS)
    got = (rows.sample(need / n, seed) if n > need else rows).collect()
    x, w = np.array([r["x"] for r in got], float), np.array([r["w"] for r in got], float)
    width = x.shape[1] if x.ndim == 2 else 0
    return [None if j in nominal else _edges(x[:, j], w, min(max_bins, n) - 1) for j in range(width)]


def _codes(df: DataFrame, edges: list, features: str, out: str) -> DataFrame:
    """Add the array of features with every ordered one replaced by 1 + the
    number of its cut points below the value."""
    df, cols = df.withColumn("__x", vector_to_array(features)), []
    for j, cuts in enumerate(edges):
        df = df.withColumn(f"__x{j}", F.get("__x", F.lit(j)))
        if cuts is not None:
            df = ranks._with_bucket(df, f"__x{j}", cuts, f"__c{j}")
        cols.append(F.col(f"__x{j}") if cuts is None else (F.col(f"__c{j}") + 1).cast("double"))
    return df.withColumn(out, F.array(*cols)).drop("__x", *[f"__{k}{j}" for j in range(len(edges)) for k in "xc"])


@dataclass
class BinnedBoost:
    """A boosted model fitted on codes (:func:`fit`) with its cut points."""

    model: GBTRegressionModel
    edges: list
    features: str

    @property
    def trees(self) -> list:
        return self.model.trees

    @property
    def treeWeights(self) -> list:  # noqa: N802
        return self.model.treeWeights

    @property
    def featureImportances(self):  # noqa: N802
        return self.model.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        coded = _codes(df, self.edges, self.features, "__codes").withColumn("__codes", array_to_vector("__codes"))
        return self.model.transform(coded).drop("__codes")

    def threshold(self, feature: int, value: float) -> float:
        """The feature's value at a split of its code: codes up to ``value`` go left."""
        return self.edges[feature][int(value) - 1]


class BinnedTree(BinnedBoost):
    """The same for a single tree."""

    @property
    def trees(self) -> list:
        return [self.model]

    @property
    def treeWeights(self) -> list:  # noqa: N802
        return [1.0]


#: Rows per cell from which forests and single trees are fitted on counted rows.
ROWS_PER_CELL = 4
#: Cells x trees up to which forests are fitted on counted rows (bags of all cells are kept).
BAGS = 1_000_000_000


def _plain_defaults(est) -> bool:
    """Whether a forest or tree has the settings that the counted fit knows."""
    forest = isinstance(est, (RandomForestRegressor, RandomForestClassifier))
    if not forest and not isinstance(est, DecisionTreeClassifier):
        return False
    if est.getMinInstancesPerNode() != 1 or est.getMinInfoGain() != 0 or est.getMinWeightFractionPerNode() != 0 or est.isSet("weightCol"):
        return False
    if not isinstance(est, RandomForestRegressor) and (est.getImpurity() != "gini" or est.isSet("thresholds")):
        return False
    return not forest or (est.getBootstrap() and est.getSubsamplingRate() == 1.0 and est.getFeatureSubsetStrategy() == "auto" and est.getNumTrees() > 1
                          and est.getMaxDepth() <= 8 and not est.getLeafCol())


def _counted_trees(est, train: DataFrame):
    """A forest or tree fitted on rows per (cell, label), or None where rows
    are few, hardly share cells, or MLlib has to judge them."""
    features, y = est.getFeaturesCol(), est.getLabelCol()
    if not _plain_defaults(est) or (n := train.count()) <= PLAIN_ROWS:
        return None
    edges = bin_edges(train, features, est.getMaxBins(), seed=est.getSeed())
    if not edges or any(c is None for c in edges):
        return None
    coded = _codes(train.select(features, F.col(y).cast("double").alias("__y")), edges, features, "__codes").select(
        F.transform("__codes", lambda c: (c - 1).cast("smallint")).alias("__codes"), "__y")
    cells = coded.agg(F.approx_count_distinct(F.xxhash64("__codes"))).first()[0]
    forest = not isinstance(est, DecisionTreeClassifier)
    if cells * ROWS_PER_CELL > n or (forest and cells * est.getNumTrees() > BAGS):
        return None
    counted = materialize(coded.groupBy("__codes", "__y").agg(F.count(F.lit(1)).alias("__m")))
    bad = F.col("__y").isNull() | F.isnan("__y") | (F.abs("__y") == float("inf"))
    if not isinstance(est, RandomForestRegressor):
        bad = bad | (F.col("__y") < 0) | (F.col("__y") != F.floor("__y")) | (F.col("__y") >= 100)
    seen = counted.agg(F.count(F.lit(1)).alias("n"), F.max("__y").alias("top"), F.max(bad).alias("bad")).first()
    if seen["bad"]:
        return None
    if not forest:
        if seen["n"] < est.getMaxBins():  # MLlib takes no more bins than rows
            return None
        rows = counted.select(array_to_vector(F.transform("__codes", lambda c: c + 1.0)).alias("__codes"), F.col("__y").alias(y), F.col("__m").cast("double").alias("__m"))
        return BinnedTree(est.copy()._set(featuresCol="__codes", weightCol="__m").fit(rows), edges, features)
    classes = 0 if isinstance(est, RandomForestRegressor) else max(2, int(seen["top"]) + 1)
    mtry = -(-len(edges) // 3) if not classes else math.ceil(math.sqrt(len(edges)))
    return forests.grow(counted, seen["n"], edges, est.getNumTrees(), est.getMaxDepth(), mtry, classes, est.getSeed(), features)


def fit(est, train: DataFrame, weight: str | None = None):
    """Fit a learner. Trees see an ordered feature only through the bins
    between its cut points: beyond ``PLAIN_ROWS`` rows are counted first, so
    that a tree costs (distinct binned rows), at most the rows and bounded by
    the bins. Boosting with squared loss sees rows that share all bins only
    through their number and mean. Forests bag the rows themselves
    (:mod:`panelkit.operators.forests`) while at least ``ROWS_PER_CELL`` rows share a
    cell, else by MLlib."""
    if not weight and (counted := _counted_trees(est, train)) is not None:
        return counted
    if not isinstance(est, GBTRegressor) or est.getLossType() != "squared" or est.getSubsamplingRate() != 1.0 or est.getMinInstancesPerNode() != 1:
        return est._set(weightCol=weight).fit(train) if weight else est.fit(train)
    if train.count() <= PLAIN_ROWS:
        return est._set(weightCol=weight).fit(train) if weight else est.fit(train)
    features, y = est.getFeaturesCol(), est.getLabelCol()
    train = train.select(features, F.col(y).cast("double").alias(y), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")).where("__w > 0")
    edges = bin_edges(train, features, est.getMaxBins(), "__w")
    if not edges:
        return est.fit(train)  # no rows: MLlib's own error
    mean = F.when(F.count(y) == F.count(F.lit(1)), F.sum(F.col("__w") * F.col(y)) / F.sum("__w"))  # a null label stays MLlib's error
    cells = materialize(_codes(train, edges, features, "__codes").groupBy("__codes").agg(mean.alias(y), F.sum("__w").alias("__n")))
    n, cores = cells.count(), train.sparkSession.sparkContext.defaultParallelism
    if n < est.getMaxBins():  # MLlib takes no more bins than rows
        return est._set(weightCol="__w").fit(train)
    attrs = train.schema[features].metadata
    coded = cells.repartition(max(1, min(n // CELL_ROWS, max(cores, n // 1_000_000)))).withColumn(
        "__codes", array_to_vector("__codes").alias("__codes", metadata=attrs))
    return BinnedBoost(est.copy()._set(featuresCol="__codes", weightCol="__n").fit(coded), edges, features)


def mlp(n_features: int, n_classes: int, hidden: Sequence[int] = (128, 512, 1024, 1024), max_iter: int = 100,
        label: str = "label", features: str = "features", seed: int = 42) -> MultilayerPerceptronClassifier:
    """K4: MLlib multilayer perceptron (sigmoid hidden units, L-BFGS)."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=max_iter, seed=seed,
                                          labelCol=label, featuresCol=features)


def mlp_run(train: DataFrame, parts: dict[str, DataFrame], n_features: int, n_classes: int, hidden: Sequence[int],
            steps: int, block: int, label: str = "label", features: str = "features", seed: int = 42) -> tuple[list, dict]:
    """One training run of ``steps`` iterations in blocks; every block
    starts from the weights of the last one, so the history belongs to one run.
    Returns (history rows (step, split, metric, value), step -> model): the loss
    of every iteration, accuracy and macro F1 of every part after each block.

    Beyond ``PLAIN_ROWS`` training rows the same loss is minimized by the same
    optimizer on packed rows (:mod:`panelkit.operators.perceptron`)."""
    args = (n_features, n_classes, hidden, block, label, features, seed)
    if (rows := train.count()) > PLAIN_ROWS and (got := _packed_mlp_run(train, parts, rows, steps, *args)) is not None:
        return got
    weights, history, models_ = None, [], {}
    for step in range(block, steps + 1, block):
        est = mlp(*args)
        if weights is not None:
            est = est.setInitialWeights(weights)
        m = est.fit(train)
        weights, models_[step] = m.weights, m
        losses = m.summary().objectiveHistory  # starts with the loss of the initial weights
        history += [(step - block + i, "train", "loss", float(v)) for i, v in enumerate(losses) if i or step == block]
        for name, part in parts.items():
            sc = m.transform(part).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
            r = metrics.macro_scores(sc, "y", "p", n_classes).first()
            history += [(step, name, "accuracy", float(r["accuracy"])), (step, name, "macro_f1", float(r["macro_f1"] or 0))]
    return history, models_


def _packed_mlp_run(train: DataFrame, parts: dict[str, DataFrame], rows: int, steps: int, n_features: int, n_classes: int, hidden: Sequence[int],
                    block: int, label: str, features: str, seed: int):
    """:func:`mlp_run` on packed rows, or None for rows that MLlib has to judge."""
    sizes, args = [n_features, *hidden, n_classes], (n_features, n_classes, hidden, 0, label, features, seed)
    packed = {"": perceptron.pack(train, features, label, sizes, rows)}
    try:
        if packed[""].agg(F.sum("bad")).first()[0]:
            return None
        for name, part in parts.items():
            if part is not train:
                scored = part.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))
                packed[name] = perceptron.pack(scored, features, label, sizes, scored.count())
        one = materialize(train.limit(1))  # MLlib's models of given weights are fits of no iterations
        weights, history, models_ = mlp(*args).fit(one).weights.toArray(), [], {}
        for step in range(block, steps + 1, block):
            weights, losses, seen = perceptron.train(packed[""], weights, sizes, block)
            models_[step] = mlp(*args).setInitialWeights(Vectors.dense(weights)).fit(one)
            history += [(step - block + i, "train", "loss", v) for i, v in enumerate(losses) if i or step == block]
            for name, part in parts.items():
                counts = perceptron.evaluate(packed[name], weights, sizes, gradient=False)[2] if name in packed else seen
                accuracy, f1 = perceptron.macro_scores(counts)
                history += [(step, name, "accuracy", float(accuracy)), (step, name, "macro_f1", float(f1 or 0))]
        return history, models_
    finally:
        for x in packed.values():
            x.unpersist()


def score(model, df: DataFrame, probabilities: bool = False) -> DataFrame:
    """K5: batch scoring; classifiers add ``probs`` ARRAY<DOUBLE>."""
    out = model.transform(df)
    if probabilities and "probability" in out.columns:
        out = out.withColumn("probs", vector_to_array("probability"))
    return out


def compare_models(train: DataFrame, test: DataFrame, y: str, presets: Sequence[str],
                   features: str = "features") -> DataFrame:
    """K7: fit each preset on train, score test, one metrics row per model
    (plus the constant train-mean predictor as a floor)."""
    rows = []
    mean = train.agg(F.avg(y).alias("__m"))
    base = test.crossJoin(F.broadcast(mean)).withColumn("prediction", F.col("__m"))
    rows.append(metrics.regression_metrics(base, y, "prediction").withColumn("model", F.lit("train_mean")))
    for p in presets:
        m = fit(learner(p, label=y, features=features), train)
        rows.append(metrics.regression_metrics(score(m, test), y, "prediction").withColumn("model", F.lit(p)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("model", "n", "mae", "mse", "rmse", "r2")


# ------------------------------------------------------------------ tree internals
def _walk(jnode, tree: int, rows: list, node_id: list, depth: int = 0) -> int:
    my = node_id[0]
    node_id[0] += 1
    stats = jnode.impurityStats()
    count = float(stats.count()) if stats is not None else 0.0
    if jnode.getClass().getSimpleName() == "InternalNode":
        split = jnode.split()
        feat = int(split.featureIndex())
        ordered = split.getClass().getSimpleName() == "ContinuousSplit"
        thr = float(split.threshold()) if ordered else None
        cats = None if ordered else sorted(float(c) for c in split.leftCategories())
        rec = [tree, my, feat, thr, float(jnode.gain()), count, float(jnode.prediction()), -1, -1, depth, cats]
        rows.append(rec)
        rec[7] = _walk(jnode.leftChild(), tree, rows, node_id, depth + 1)
        rec[8] = _walk(jnode.rightChild(), tree, rows, node_id, depth + 1)
    else:
        rows.append([tree, my, -1, None, 0.0, count, float(jnode.prediction()), -1, -1, depth, None])
    return my


def tree_list(model) -> tuple[list, list[float]]:
    """(trees, weights) of a tree or ensemble model: forest weights 1/T,
    boosted weights as fitted, single tree 1."""
    if hasattr(model, "trees"):
        trees = list(model.trees)
        if isinstance(model, BinnedBoost) or hasattr(model, "treeWeights") and model.__class__.__name__.startswith("GBT"):
            return trees, [float(w) for w in model.treeWeights]
        return trees, [1.0 / len(trees)] * len(trees)
    return [model], [1.0]


def node_rows(model) -> list[list]:
    if isinstance(model, forests.CountedForest):
        return model.node_rows()
    rows: list[list] = []
    trees, weights = tree_list(model)
    for t, tr in enumerate(trees):
        part: list[list] = []
        _walk(tr._java_obj.rootNode(), t, part, [0])
        for r in part:
            r.append(weights[t])
            if isinstance(model, BinnedBoost) and r[3] is not None:
                r[3] = model.threshold(r[2], r[3])
        rows += part
    return rows


NODE_SCHEMA = ("tree int, node int, feature int, threshold double, gain double, cover double, value double, "
               "left int, right int, depth int, left_categories array<double>, weight double")


def node_table(spark, model, feature_names: Sequence[str] | None = None) -> DataFrame:
    """Flat node table (tree, node, feature, threshold, gain, cover, value,
    left, right, depth, left_categories, weight[, feature_name]). An ordered
    split sends ``x <= threshold`` left; a categorical one has no threshold and
    sends the codes in ``left_categories`` left."""
    df = spark.createDataFrame(node_rows(model), NODE_SCHEMA)
    if feature_names is not None:
        names = F.array(*[F.lit(n) for n in feature_names])
        df = df.withColumn("feature_name", F.when(F.col("feature") >= 0, F.element_at(names, F.col("feature") + 1)))
    return df


def impurity_importance(spark, model, feature_names: Sequence[str], model_name: str) -> DataFrame:
    """L1: MLlib impurity importance per feature with the population sd of
    the per-tree importances (D19 forest rule)."""
    trees, _ = tree_list(model)
    rows = []
    for t, tr in enumerate(trees):
        v = tr.featureImportances.toArray()
        rows += [(t, feature_names[i], float(v[i])) for i in range(len(feature_names))]
    per = spark.createDataFrame(rows, "tree int, feature string, importance double")
    tot = model.featureImportances.toArray()
    overall = spark.createDataFrame([(feature_names[i], float(tot[i])) for i in range(len(feature_names))],
                                    "feature string, importance double")
    sd = per.groupBy("feature").agg(F.stddev_pop("importance").alias("sd"))
    return overall.join(sd, "feature").withColumn("model", F.lit(model_name))


def per_tree_importances(spark, model, feature_names: Sequence[str]) -> DataFrame:
    """(tree, feature, importance) from each tree's ``featureImportances``."""
    trees, _ = tree_list(model)
    rows = []
    for t, tr in enumerate(trees):
        v = tr.featureImportances.toArray()
        rows += [(t, feature_names[i], float(v[i])) for i in range(len(feature_names))]
    return spark.createDataFrame(rows, "tree int, feature string, importance double")


def importances_table(spark, models: dict, feature_names: Sequence[str]) -> DataFrame:
    """K9: tidy (feature, model, importance) from ``featureImportances``."""
    rows = []
    for name, m in models.items():
        v = m.featureImportances.toArray()
        rows += [(feature_names[i], name, float(v[i])) for i in range(len(feature_names))]
    return spark.createDataFrame(rows, "feature string, model string, importance double")


# ------------------------------------------------------------------ K8 leaf distributions
#: Leaf-table rows (about 25 bytes each) up to which the table is sent to every task.
BROADCAST_ROWS = 1_000_000


def leaf_ids(model, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """One row per (row, tree): the kept columns, tree, leaf."""
    m = model.copy({model.leafCol: "__leaf", model.featuresCol: features, model.predictionCol: "__p"})
    ids = m.transform(df).select(*keep, vector_to_array("__leaf").alias("__leaf"))
    return ids.select(*keep, F.posexplode("__leaf").alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))


def value_grid(df: DataFrame, y: str, grid: int = 200) -> list[float]:
    """The distinct values of ``y`` while there are at most ``grid``, else
    ``grid`` approximate quantiles with the extremes."""
    few = [r[0] for r in df.select(F.col(y).cast("double")).where(F.col(y).isNotNull()).distinct().limit(grid + 1).collect()]
    if len(few) <= grid:
        return sorted(few)
    probs = [i / (grid - 1) for i in range(grid)]
    ends = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.percentile_approx(F.col(y).cast("double"), probs, 50 * grid).alias("q")).first()
    return sorted({float(ends["lo"]), float(ends["hi"]), *map(float, ends["q"])})


def leaf_weights(leaves: DataFrame, value: str) -> DataFrame:
    """K8: the response distribution of every leaf, (tree, leaf, value,
    weight), from training rows (tree, leaf, ``value``): value counts over the
    leaf's rows. Counts combine map-side; one row per leaf and distinct value."""
    return _shares(leaves.where(F.col(value).isNotNull()).groupBy("tree", "leaf", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def _shares(counts: DataFrame) -> DataFrame:
    sizes = counts.groupBy("tree", "leaf").agg(F.sum("n").alias("size"))
    return counts.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "value", (F.col("n") / F.col("size")).alias("weight"))


def leaf_table(model, train: DataFrame, y: str, features: str = "features", grid: int = 200) -> DataFrame:
    """K8: :func:`leaf_weights` of a fitted forest over its training rows, y
    raised to the next value of :func:`value_grid`: at most trees x leaves x
    grid rows, whatever the training table's size."""
    values = value_grid(train, y, grid)
    rows = ranks._with_bucket(train.select(features, F.col(y).cast("double").alias("__y")), "__y", values)  # one search per row, not per leaf
    rows = rows.withColumn("value", F.when(F.col("__y").isNotNull(), F.get(F.lit(values), F.col("__b"))))
    return _shares(leaf_ids(model, rows, ["value"], features).groupBy("tree", "leaf", "value").agg(F.count(F.lit(1)).alias("n")))


def _fits(table: DataFrame) -> bool:
    return table.schema["value"].dataType.typeName() == "double" and 0 < table.count() <= BROADCAST_ROWS


@dataclass
class _Leaves:
    """A leaf table as arrays: the values in order (null first), and per slot
    (tree x width + leaf) the range of its entries (value number, weight)."""

    values: np.ndarray
    start: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    trees: int
    width: int

    @classmethod
    def of(cls, table: DataFrame) -> _Leaves:
        t = table.select("tree", "leaf", F.col("value").isNotNull().cast("int").alias("known"), F.coalesce("value", F.lit(0.0)).alias("value"),
                         "weight").toPandas()  # at most BROADCAST_ROWS
        values, at = np.unique(t[["known", "value"]].to_numpy(float), axis=0, return_inverse=True)
        trees, width = int(t["tree"].max()) + 1, int(t["leaf"].max()) + 1
        slot = (t["tree"] * width + t["leaf"]).to_numpy()
        order = np.lexsort((at.ravel(), slot))
        start = np.searchsorted(slot[order], np.arange(trees * width + 1))
        return cls(np.where(values[:, 0] > 0, values[:, 1], np.nan), start, at.ravel()[order], t["weight"].to_numpy(float)[order], trees, width)

    def slot(self, tree, leaf):
        inside = (tree >= 0) & (tree < self.trees) & (leaf >= 0) & (leaf < self.width)
        return F.when(inside, tree * self.width + leaf).otherwise(-1).cast("int")

    def quantiles(self, row: np.ndarray, slot: np.ndarray, times: np.ndarray, rows: int, qs: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """(rows with a known leaf, their quantiles) of ``rows`` mixtures."""
        row, slot, times = (a[slot >= 0] for a in (row, slot, times))
        size = self.start[slot + 1] - self.start[slot]
        entry = np.repeat(self.start[slot] - np.cumsum(size) + size, size) + np.arange(size.sum())
        width = len(self.values)
        cell = np.repeat(row * width, size) + self.at[entry]
        mix = np.bincount(cell, self.weight[entry] * np.repeat(times, size), rows * width).reshape(rows, width)
        some = np.bincount(cell, minlength=rows * width).reshape(rows, width) > 0
        met = some.any(axis=1)
        mix, some = mix[met], some[met] & ~np.isnan(self.values)
        upto = np.cumsum(mix, axis=1)
        share = upto / upto[:, -1:]
        found = np.full((len(mix), len(qs)), np.nan)
        for i, q in enumerate(qs):
            hit = some & (share >= q - 1e-9)
            first = hit.argmax(axis=1)
            found[:, i] = np.where(hit.any(axis=1), self.values[first], np.nan)
        return met, found


#: Leaf entries of rows that are mixed at a time.
_MIX = 20_000


def _summed(lists: DataFrame, dense: _Leaves, key: str, quantiles: Sequence[float], out: str) -> DataFrame:
    """Quantiles per key from its lists of slots; equal lists are counted first."""
    per = lists.groupBy(key, "__slots").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.collect_list(F.struct("__slots", "n")).alias("__all"))
    shared, qs = lists.sparkSession.sparkContext.broadcast(dense), list(quantiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            step = max(1, _MIX // max(1, table.trees))
            for b in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                parts = b.column(1).flatten()
                each = parts.field("__slots").value_lengths().to_numpy(zero_copy_only=False)
                of = np.repeat(np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False)), each)
                slots = parts.field("__slots").flatten().to_numpy(zero_copy_only=False)
                times = np.repeat(parts.field("n").to_numpy(zero_copy_only=False), each)
                met, found = table.quantiles(of, slots, times, b.num_rows, qs)
                kept = b.column(0).filter(pa.array(met))
                flat = pa.array(found.ravel(), mask=np.isnan(found.ravel()))
                yield pa.RecordBatch.from_arrays([kept, pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(qs), flat)], [key, out])

    return per.select(key, "__all").mapInArrow(run, f"`{key}` {lists.schema[key].dataType.simpleString()}, `{out}` array<double>")


def mixture_quantiles(leaves: DataFrame, table: DataFrame, key: str, quantiles: Sequence[float], out: str = "qpred") -> DataFrame:
    """K8: per scored row the quantiles of the response: the mean of the
    distributions of its leaves (``leaves``: key, tree, leaf), read at the least
    value whose share reaches the quantile. Adds ARRAY<DOUBLE> ``out``.

    While the leaf table is small (counted first) it goes to every task, and
    what is shuffled is a row's list of leaves; a larger one meets the leaves
    in a join, and weights add up per (row, value) map-side."""
    table = materialize(table)
    if _fits(table):
        dense = _Leaves.of(table)
        lists = leaves.select(key, F.array(dense.slot(F.col("tree"), F.col("leaf"))).alias("__slots"))
        return _summed(lists, dense, key, quantiles, out)
    mix = leaves.join(table, ["tree", "leaf"]).groupBy(key, "value").agg(F.sum("weight").alias("w"))
    upto = Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy(key)  # at most as many rows as the grid has values
    share = mix.withColumn("share", F.sum("w").over(upto) / F.sum("w").over(all_))
    least = [F.min(F.when(F.col("share") >= q - 1e-9, F.col("value"))) for q in quantiles]
    return share.groupBy(key).agg(F.array(*least).alias(out))


def forest_quantiles(model, df: DataFrame, table: DataFrame, key: str, quantiles: Sequence[float], features: str = "features",
                     out: str = "qpred") -> DataFrame:
    """K8: ``df`` with the predicted quantiles of the response."""
    table = materialize(table)
    if _fits(table):
        dense = _Leaves.of(table)
        m = model.copy({model.leafCol: "__leaf", model.featuresCol: features, model.predictionCol: "__p"})
        ids = m.transform(df.where(F.col(key).isNotNull())).select(key, vector_to_array("__leaf").alias("__leaf"))
        lists = ids.select(key, F.transform("__leaf", lambda x, t: dense.slot(t, x.cast("int"))).alias("__slots"))
        found = _summed(lists, dense, key, quantiles, out)
    else:
        found = mixture_quantiles(leaf_ids(model, df, [key], features), table, key, quantiles, out)
    return df.join(found, key, "left")


# ------------------------------------------------------------------ A8 persistence
def save_model(spark, model, path: str, meta: dict) -> None:
    """MLlib writer plus a one-row metadata table (class count, class values, label mode, metrics)."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/meta")


def load_model(spark, cls, path: str, expected_classes: int | None = None):
    """Load model + metadata, check the stored class count."""
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    if expected_classes is not None and int(meta.get("num_classes", -1)) != int(expected_classes):
        raise ValueError(f"checkpoint has {meta.get('num_classes')} classes, expected {expected_classes}")
    return cls.load(f"{path}/model"), meta
