"""Model training, scoring and explainability queries over the proxy
``signal`` table (survey K1-K10, L1-L12, A8)."""

from __future__ import annotations

import itertools
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelkit.functions.random import portable_uniform, uniform_sql
from panelkit.operators import encode, explain, forests, importance, metrics, models, ranks, split
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx

NUMERIC = ["c_acctbal", "o_totalprice"]
CATEGORICAL = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]
Y = "target"
#: Combinations of codes up to which a forest's predictions are kept in a table.
TABLE_CELLS = 1_000_000


_MEMO: dict = {}


def _memo(spark, sf_dir, name, build):
    """Reuse a fitted preparation/model across queries of one session (model-sized objects)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    for old in [k for k in _MEMO if k[:2] != key[:2]]:  # one session and one folder at a time
        gone = _MEMO.pop(old)
        if old[0] == key[0] and old[2] in ("frames", "prepared"):
            gone[-1].unpersist()
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def _prepared(spark, sf_dir):
    """Signal table, grouped 80/20 split by customer (H2), prep fitted on train.
    The split table is kept: the joins behind it are made once."""
    def build():
        s = split.group_split(fx.signal(spark, sf_dir), "grp", test=0.2, seed=42).persist()
        return models.fit_prep(s.where(F.col("split") == "train"), NUMERIC, CATEGORICAL), s

    prep, s = _memo(spark, sf_dir, "prepared", build)
    return s, prep


def _frames(spark, sf_dir):
    def build():
        s, prep = _prepared(spark, sf_dir)
        d = prep.transform(s).cache()
        return d.where(F.col("split") == "train"), d.where(F.col("split") == "test"), prep, d

    return _memo(spark, sf_dir, "frames", build)[:3]


def _raw_test(spark, sf_dir):
    """Unscaled test rows (the scorers apply the fitted preparation themselves)."""
    return _prepared(spark, sf_dir)[0].where(F.col("split") == "test").select("row_id", Y, *NUMERIC, *CATEGORICAL)


def _scorer(model, prep):
    """Scorer protocol: adds ``prediction``, leaves the input columns as they
    were. For a counted forest, ``score.counted(df, feature, by)`` counts the rows
    that it scores alike whatever ``feature`` is set to: ``by``, the model's
    columns of one such row, ``__n``. ``score.table(df, y, features, key)`` has its
    predictions of all codes: (rows with codes for features, features, codes of each,
    predictions), or None where it does not know them."""
    def counted(df, feature, by):
        cuts, raw = dict(zip(prep.feature_names, model.cuts)), [F.col(c).alias(f"__raw_{c}") for c in prep.numeric]
        d, others = prep.transform(df.select("*", *raw)), [c for c in prep.numeric if c != feature and c not in by]
        for c in others:  # the model sees 0 for null
            d = ranks._with_bucket(d.withColumn("__v", F.coalesce(F.col(c).cast("double"), F.lit(0.0))), "__v", cuts[c], f"__bin_{c}")
        group = [F.col(f"__raw_{c}").alias(c) if c in prep.numeric else F.col(c) for c in by]
        group += [F.col(c) for c in prep.levels if c != feature and c not in by] + [F.col(f"__bin_{c}") for c in others]
        one = [F.min(f"__raw_{c}").alias(c) for c in others]
        return d.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), *one).drop(*[f"__bin_{c}" for c in others])

    def table(df, y, features, key):
        cuts = dict(zip(prep.feature_names, model.cuts))
        sizes = [len(cuts[c]) + 1 if c in prep.numeric else len(prep.levels.get(c, ())) for c in features]
        if (model.classes or prep.mode != "one_hot" or sorted(features) != sorted([*prep.numeric, *prep.levels]) or {y, key} & set(features)
                or not 0 < np.prod(sizes, dtype=float) <= TABLE_CELLS or max(sizes) > 2**15):
            return None
        grid = dict(zip(features, np.indices(sizes).reshape(len(sizes), -1)))
        x = [np.r_[cuts[c], np.inf][grid[c]] for c in prep.numeric]  # the largest value of every bin
        x += [(grid[c] == i).astype(float) for c, lvs in prep.levels.items() for i in range(1, len(lvs))]
        d = encode.codes(prep.transform(df), prep.levels, unseen=0)  # other levels and null have no column, as the first
        for c in prep.numeric:  # the model sees 0 for null
            d = ranks._with_bucket(d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))), c, cuts[c], "__bin").withColumn(c, F.col("__bin"))
        coded = d.select(key, y, *[F.col(c).cast("tinyint" if n <= 127 else "smallint").alias(c) for c, n in zip(features, sizes)])
        return coded, features, sizes, model.predictions(np.array(x).T)

    def score(df):
        drop = [c for c in prep.feature_names if c in df.columns and c not in prep.numeric] + ["features"]
        base = df.drop(*[c for c in drop if c in df.columns])
        base = base.select("*", *[F.col(c).alias(f"__raw_{c}") for c in prep.numeric])
        out = model.transform(prep.transform(base)).drop(*prep.feature_names[len(prep.numeric):], "features")
        for c in prep.numeric:
            out = out.withColumn(c, F.col(f"__raw_{c}")).drop(f"__raw_{c}")
        return out.drop(*[c for c in ("rawPrediction", "probability") if c in out.columns])

    if isinstance(model, forests.CountedForest):
        score.counted, score.table = counted, table
    return score


# ------------------------------------------------------------------ K1, K2, K7
def model_comparison(spark, sf_dir):
    train, test, _ = _frames(spark, sf_dir)
    return models.compare_models(train, test, Y, ["forest", "boost"])


register("model_comparison", "K1 K2 K5 K7 H2 C3 B15 B22 D8")(model_comparison)


def boost_native_categoricals(spark, sf_dir):
    """K2 with native (coded, nominal-metadata) categorical features."""
    s = split.group_split(fx.signal(spark, sf_dir), "grp", test=0.2, seed=42)
    prep = models.fit_prep(s.where(F.col("split") == "train"), NUMERIC, CATEGORICAL, mode="codes")
    d = prep.transform(s).cache()
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    m = models.fit(models.learner("boost", label=Y, maxBins=32), train)
    out = metrics.regression_metrics(models.score(m, test), Y, "prediction").withColumn("model", F.lit("boost_native"))
    imp = models.importances_table(spark, {"boost_native": m}, prep.feature_names)
    return out.crossJoin(imp.groupBy().pivot("feature").agg(F.first("importance")))


register("boost_native_categoricals", "K2 B24")(boost_native_categoricals)


# ------------------------------------------------------------------ K8 + D9
QUANTILES = [0.25, 0.5, 0.75]


def forest_quantiles(spark, sf_dir):
    train, test, _ = _frames(spark, sf_dir)
    m = models.learner("forest", label=Y).fit(train)
    q = models.forest_quantiles(m, test, models.leaf_table(m, train, Y), "row_id", QUANTILES)
    long = encode.unpivot_quantiles(q, "qpred", QUANTILES, keep=["row_id", Y])
    return metrics.quantile_mae(long, Y)


register("forest_quantiles", "K8 B34 D9")(forest_quantiles)


def forest_interval_coverage(spark, sf_dir):
    """K8: share of held-out rows of a noisy response inside its 25-75 % interval."""
    noise = (portable_uniform(F.lit(7), F.col("row_id")) - 0.5) * 2
    train, test = (d.withColumn("noisy", F.col(Y) + noise) for d in _frames(spark, sf_dir)[:2])
    m = models.learner("forest", label="noisy").fit(train)
    q = models.forest_quantiles(m, test, models.leaf_table(m, train, "noisy"), "row_id", QUANTILES)
    inside = (F.col("noisy") >= F.col("qpred")[0]) & (F.col("noisy") <= F.col("qpred")[2])
    return q.agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"),
                 F.avg(F.col("qpred")[2] - F.col("qpred")[0]).alias("mean_width"))


register("forest_interval_coverage", "K8")(forest_interval_coverage)


def leaf_mixture_quantiles(spark, sf_dir):
    """K8 on given leaves: orders fall into 5 trees of 7 leaves by customer,
    customers are scored."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tree")

    def leaf(key: str):
        return ((F.col(key) * (F.col("tree") + 3) + F.col("tree")) % 7).cast("int").alias("leaf")

    o = fx.table(spark, sf_dir, "orders").select("o_custkey", F.round(F.col("o_totalprice") / 5000).alias("y"), trees)
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", trees)
    table = models.leaf_weights(o.select("tree", leaf("o_custkey"), "y"), "y")
    q = models.mixture_quantiles(c.select("c_custkey", "tree", leaf("c_custkey")), table, "c_custkey", QUANTILES)
    return q.select("c_custkey", *[F.col("qpred")[i].alias(f"q{int(100 * p)}") for i, p in enumerate(QUANTILES)])


register("leaf_mixture_quantiles", "K8 B34", """
WITH t AS (SELECT CAST(tree AS BIGINT) AS tree FROM range(5) t(tree)),
o AS (SELECT tree, (o_custkey * (tree + 3) + tree) % 7 AS leaf, round(o_totalprice / 5000) AS value FROM orders, t),
n AS (SELECT tree, leaf, value, count(*) AS n FROM o GROUP BY tree, leaf, value),
w AS (SELECT tree, leaf, value, n / sum(n) OVER (PARTITION BY tree, leaf) AS weight FROM n),
m AS (SELECT c_custkey, value, sum(weight) AS w FROM customer, t, w
      WHERE w.tree = t.tree AND w.leaf = (c_custkey * (t.tree + 3) + t.tree) % 7 GROUP BY ALL),
s AS (SELECT c_custkey, value, sum(w) OVER (PARTITION BY c_custkey ORDER BY value ROWS UNBOUNDED PRECEDING)
             / sum(w) OVER (PARTITION BY c_custkey) AS share FROM m)
SELECT c_custkey, """ + ", ".join(f"CAST(min(CASE WHEN share >= {p} - 1e-9 THEN value END) AS DOUBLE) AS q{int(100 * p)}" for p in QUANTILES)
         + " FROM s GROUP BY c_custkey")(leaf_mixture_quantiles)


# ------------------------------------------------------------------ K9, L1, D17, D18
def model_importances(spark, sf_dir):
    train, _, prep = _frames(spark, sf_dir)
    names = prep.feature_names
    forest = models.fit(models.learner("forest", label=Y), train)
    boost = models.fit(models.learner("boost", label=Y), train)
    tidy = models.importances_table(spark, {"forest": forest, "boost": boost}, names)
    cons = importance.consolidate(tidy, NUMERIC + CATEGORICAL, strip_prefix=None)
    norm = importance.normalize(cons)
    sds = []
    for name, m in (("forest", forest), ("boost", boost)):  # L1: sd over trees of the parent's per-tree importance
        per = importance.consolidate(models.per_tree_importances(spark, m, names), NUMERIC + CATEGORICAL,
                                     model="tree", strip_prefix=None)
        sds.append(per.groupBy("feature").agg(F.stddev_pop("importance").alias("sd_over_trees"))
                   .withColumn("model", F.lit(name)))
    return norm.join(sds[0].unionByName(sds[1]), ["feature", "model"], "left")


register("model_importances", "K9 L1 D17 D18 D19")(model_importances)


def tree_node_spread(spark, sf_dir):
    train, _, prep = _frames(spark, sf_dir)
    boost = models.fit(models.learner("boost", label=Y, maxIter=30, maxDepth=4), train)
    nodes = models.node_table(spark, boost, prep.feature_names).where(F.col("feature") >= 0)
    return importance.spread_over_trees(nodes.select("tree", F.col("feature_name").alias("feature"), "gain"), sd="samp")


register("tree_node_spread", "D19 K2")(tree_node_spread)


# ------------------------------------------------------------------ K3, K5, D10-D16 on a model
def classifier_scores(spark, sf_dir):
    train, test, _ = _frames(spark, sf_dir)
    lab = lambda d: d.withColumn("high", encode.binary_target(Y).cast("double"))
    m = models.fit(models.learner("forest_classifier300", label="high"), lab(train))
    sc = models.score(m, lab(test), probabilities=True).withColumn("y", F.col("high").cast("int")).withColumn(
        "p", F.col("prediction").cast("int"))
    a = metrics.macro_scores(sc, "y", "p", 2)
    b = metrics.ece(sc, "y", "probs")
    c = metrics.cross_entropy(sc, "y", "probs", eps=1e-15)
    return a.crossJoin(b).crossJoin(c)


register("classifier_scores", "K3 K5 D10 D15 D16 B19")(classifier_scores)


# ------------------------------------------------------------------ K4, K6, K10, E8, A8, H3
def mlp_training(spark, sf_dir):
    s, prep = _prepared(spark, sf_dir)
    # the kept rows are the raw columns; features are made on the way, as a vector of doubles takes several times their room
    kept = split.exact_split(s.drop("split"), "row_id", (0.8, 0.1, 0.1), seed=1337).select("split", Y, *NUMERIC, *CATEGORICAL).cache()
    d, classes = encode.label(prep.transform(kept), Y, "floor", out="label")
    d = d.select("split", "features", F.col("label").cast("double").alias("label"))
    tr, va, te = (d.where(F.col("split") == n) for n in ("train", "valid", "test"))
    nf, k = len(prep.feature_names), len(classes)
    history, fitted = models.mlp_run(tr, {"train": tr, "valid": va}, nf, k, (64, 32), steps=60, block=10)
    f1 = [(h[0], h[3]) for h in history if h[1:3] == ("valid", "macro_f1")]
    step = max(f1, key=lambda x: (x[1], -x[0]))[0]  # E8: the first step that reaches the best validation F1
    best = (dict(f1)[step], step, fitted[step])
    import uuid

    from panelkit.session import ensure_checkpoint_dir

    shared = ensure_checkpoint_dir(spark)  # the session's shared folder, never a machine-local one
    path = f"{shared.rstrip('/')}/models/mlp-{uuid.uuid4().hex}"
    # A8 round trip: save with metadata, load with the class-count check
    models.save_model(spark, best[2], path, {"num_classes": k, "class_values": classes, "label_mode": "floor"})
    best = (best[0], best[1], models.load_model(spark, MultilayerPerceptronClassificationModel, path, k)[0])
    sc = best[2].transform(te).select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    r = metrics.macro_scores(sc, "y", "p", k).first()
    history += [(best[1], "test", "accuracy", float(r["accuracy"])), (best[1], "test", "macro_f1", float(r["macro_f1"] or 0))]
    kept.unpersist()
    return spark.createDataFrame(history, "step int, split string, metric string, value double")


register("mlp_training", "K4 K6 K10 E8 A8 H3 B16 B18")(mlp_training)


# ------------------------------------------------------------------ L2
def permutation_importance(spark, sf_dir):
    s, prep = _prepared(spark, sf_dir)
    m = models.fit(models.learner("forest", label=Y), prep.transform(s.where(F.col("split") == "train")).select("features", Y))
    raw = _raw_test(spark, sf_dir)
    return explain.permutation_importance(_scorer(m, prep), raw, "row_id", Y, NUMERIC + CATEGORICAL, repeats=30)


register("permutation_importance", "L2 H6 F12")(permutation_importance)


def _linear_score(df):
    mx = 1.0  # fixed scorer: the target formula with the global max folded in by the caller
    return df.withColumn("prediction", F.lit(1.0) + 4 * F.col("o_totalprice") / F.col("__mx") * mx
                         + 0.5 * (F.col("c_mktsegment") == "BUILDING").cast("double"))


def permutation_importance_linear(spark, sf_dir):
    s = fx.signal(spark, sf_dir)
    mx = s.agg(F.max("o_totalprice").alias("__mx"))
    raw = s.select("row_id", Y, "o_totalprice", "c_mktsegment").crossJoin(F.broadcast(mx))
    imp = explain.permutation_importance(_linear_score, raw, "row_id", Y, ["o_totalprice", "c_mktsegment"], repeats=30)
    return imp.select("feature", F.round("importance_mean", 6).alias("importance_mean"),
                      F.round("importance_sd", 6).alias("importance_sd"))


def _combos_sql(features, repeats: int, seed: int = 42) -> str:
    """(feature, repeat, keys) of the keyed bijections as a VALUES list."""
    return ", ".join(f"('{f}', {r}, {split.bijection_keys(seed, f, r)}::BIGINT[])" for f in features for r in range(1, repeats + 1))


register("permutation_importance_linear", "L2 H6 F12", fx.with_views(f"""
, mx AS (SELECT max(o_totalprice) AS mx FROM orders),
a AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM signal),
x AS (SELECT f.feature, f.repeat, a.o_totalprice AS sp, a.c_mktsegment AS sm, {split.bijection_sql('i', 'n', 'f.keys')} AS i
      FROM a, (VALUES {_combos_sql(['o_totalprice', 'c_mktsegment'], 30)}) f(feature, repeat, keys)),
p AS (SELECT x.feature, x.repeat, x.sp, x.sm, a.target, a.o_totalprice, a.c_mktsegment FROM x JOIN a USING (i)),
sc AS (SELECT feature, repeat, target,
              1.0 + 4 * (CASE WHEN feature = 'o_totalprice' THEN sp ELSE o_totalprice END) / mx
                  + 0.5 * CAST((CASE WHEN feature = 'c_mktsegment' THEN sm ELSE c_mktsegment END) = 'BUILDING' AS DOUBLE)
                AS prediction
       FROM p, mx),
base AS (SELECT avg(abs(target - (1.0 + 4 * o_totalprice / mx + 0.5 * CAST(c_mktsegment = 'BUILDING' AS DOUBLE))))
                AS b FROM signal, mx),
d AS (SELECT feature, repeat, avg(abs(target - prediction)) - any_value(b) AS d FROM sc, base GROUP BY 1, 2)
SELECT feature, round(avg(d), 6) AS importance_mean, round(stddev_pop(d), 6) AS importance_sd FROM d GROUP BY 1""",
                                                                  "signal").replace("\n, mx AS", ",\nmx AS")
         )(permutation_importance_linear)


# ------------------------------------------------------------------ L3, L4, L5, D20
def _shap_setup(spark, sf_dir, trees=400):
    train, test, prep = _frames(spark, sf_dir)
    m = _memo(spark, sf_dir, f"gbt{trees}",
              lambda: models.fit(GBTRegressor(maxIter=trees, maxDepth=4, stepSize=0.1, seed=42, labelCol=Y), train))
    nodes = models.node_table(spark, m)
    return m, nodes, test, prep  # every test row (row-parallel mapInPandas, no sampling)


def shap_values(spark, sf_dir):
    m, nodes, rows, prep = _shap_setup(spark, sf_dir)
    sh = explain.shapley(rows, nodes, "row_id", feature_names=prep.feature_names)
    return explain.mean_abs(sh, "shap", ["feature"])


register("shap_values", "L3 D20")(shap_values)


def shap_additivity(spark, sf_dir):
    """Rows-only check table: max |sum(shap) + expected - prediction| per sample."""
    m, nodes, rows, prep = _shap_setup(spark, sf_dir)
    sh = explain.shapley(rows, nodes, "row_id", feature_names=prep.feature_names)
    tot = sh.groupBy("row_id").agg((F.sum("shap") + F.first("expected_value")).alias("reconstructed"))
    pred = m.transform(rows).select("row_id", "prediction")
    return tot.join(pred, "row_id").agg(F.max(F.abs(F.col("reconstructed") - F.col("prediction"))).alias("max_gap"),
                                        F.count(F.lit(1)).alias("n"))


register("shap_additivity", "L3")(shap_additivity)


def shap_top_interactions(spark, sf_dir):
    m, nodes, rows, prep = _shap_setup(spark, sf_dir)
    inter = explain.shapley_interactions(rows, nodes, "row_id", feature_names=prep.feature_names)
    return explain.top_pairs(inter, 15)


register("shap_top_interactions", "L4 C5 F-2 D20")(shap_top_interactions)


def shap_moderation(spark, sf_dir):
    m, nodes, rows, prep = _shap_setup(spark, sf_dir)
    sh = explain.shapley(rows, nodes, "row_id", feature_names=prep.feature_names)
    return explain.moderation(sh, rows, "row_id", "o_totalprice", "o_totalprice", "c_mktsegment")


register("shap_moderation", "L5 C7")(shap_moderation)


# ------------------------------------------------------------------ L6
def pdp_table(spark, sf_dir):
    train, test, prep = _frames(spark, sf_dir)
    m = models.fit(models.learner("forest300", label=Y), train)
    raw = _raw_test(spark, sf_dir)
    pdp, _ = explain.pdp_ice(_scorer(m, prep), raw, "o_totalprice", "row_id", by=["c_mktsegment"], points=30,
                             sample_per_cell=None)  # all rows, those that the forest tells apart x 30 grid points
    return pdp


register("pdp_table", "L6 C6 H4")(pdp_table)


def _given_score(df):
    """A fixed linear scorer."""
    return df.withColumn("prediction", 1 + F.col("o_totalprice") / 100000 + 0.5 * (F.col("c_mktsegment") == "BUILDING").cast("double"))


def ice_rows_given(spark, sf_dir):
    """L6 with a fixed scorer: the ICE rows of five orders per segment."""
    s = fx.signal(spark, sf_dir).select("row_id", "o_totalprice", "c_mktsegment")
    _, ice = explain.pdp_ice(_given_score, s, "o_totalprice", "row_id", by=["c_mktsegment"], points=12, sample_per_cell=5)
    return ice.select("row_id", "c_mktsegment", "grid_index", F.round("grid_value", 4).alias("grid_value"), F.round("prediction", 6).alias("prediction"))


def pdp_given(spark, sf_dir):
    """L6 with a fixed scorer: partial dependence over all rows of a segment."""
    s = fx.signal(spark, sf_dir).select("row_id", "o_totalprice", "c_mktsegment")
    pdp, _ = explain.pdp_ice(_given_score, s, "o_totalprice", "row_id", by=["c_mktsegment"], points=12, sample_per_cell=None)
    return pdp.select("c_mktsegment", "grid_index", F.round("grid_value", 4).alias("grid_value"), F.round("partial_dependence", 6).alias("partial_dependence"))


_ICE_SQL = f"""
, q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM signal),
grid AS (SELECT CAST(i AS BIGINT) AS grid_index, lo + (hi - lo) * i / 11 AS g FROM q, range(12) t(i)),
nth AS (SELECT row_id, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {uniform_sql('42', 'row_id')}, row_id) AS n FROM signal),
ice AS (SELECT row_id, c_mktsegment, n, grid_index, g, 1 + g / 100000 + 0.5 * CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS prediction FROM nth, grid)
"""


def _ice_oracle(select: str) -> str:
    return fx.with_views(_ICE_SQL + select, "signal").replace("\n\n, q AS", ",\nq AS")


register("ice_rows_given", "L6 H4", _ice_oracle(
    "SELECT row_id, c_mktsegment, grid_index, round(g, 4) AS grid_value, round(prediction, 6) AS prediction FROM ice WHERE n <= 5"))(ice_rows_given)
register("pdp_given", "L6 C6", _ice_oracle(
    "SELECT c_mktsegment, grid_index, round(g, 4) AS grid_value, round(avg(prediction), 6) AS partial_dependence FROM ice GROUP BY ALL"))(pdp_given)


def moderation_given(spark, sf_dir):
    """L5, C7 with given attributions, met by row identity."""
    s = fx.signal(spark, sf_dir)
    long = s.select("row_id", F.inline(F.array(
        F.struct(F.lit("o_totalprice").alias("feature"), (F.col("o_totalprice") / 50000 - F.col("c_acctbal") / 10000).alias("shap")),
        F.struct(F.lit("c_acctbal").alias("feature"), (F.col("c_acctbal") / 20000).alias("shap")))))
    out = explain.moderation(long, s, "row_id", "o_totalprice", "o_totalprice", "c_mktsegment")
    return out.select("c_mktsegment", "n", F.round("mean_shap", 6).alias("mean_shap"), F.round(F.col("slope") * 100000, 5).alias("slope"))


register("moderation_given", "L5 C7", fx.with_views("""
SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice / 50000 - c_acctbal / 10000), 6) AS mean_shap,
       round(regr_slope(o_totalprice / 50000 - c_acctbal / 10000, o_totalprice) * 100000, 5) AS slope
FROM signal GROUP BY c_mktsegment""", "signal"))(moderation_given)


# ------------------------------------------------------------------ L8
def counterfactual_changes(spark, sf_dir):
    train, test, prep = _frames(spark, sf_dir)
    lab = lambda d: d.withColumn("high", encode.binary_target(Y).cast("double"))
    m = models.fit(models.learner("forest_classifier300", label="high"), lab(train))
    raw = _raw_test(spark, sf_dir)
    # every feature may change: all levels of the categorical ones, nine quantiles of the numeric ones
    cand_rows = [(c, v) for c in CATEGORICAL for v in prep.levels[c]]
    probs = [i / 10 for i in range(1, 10)]
    q = raw.agg(*[F.percentile_approx(c, probs).alias(c) for c in NUMERIC]).first()
    cand_rows += [(c, str(float(v))) for c in NUMERIC for v in q[c]]
    cand = spark.createDataFrame(cand_rows, "feature string, value string")
    cf = explain.counterfactuals(
        _scorer(m, prep), raw, "row_id", NUMERIC + CATEGORICAL, cand, lambda p: p == 1.0,
        n_rows=8, per_row=2, select_rows=lambda d: _scorer(m, prep)(d).where(F.col("prediction") == 0.0)
        .select(*raw.columns), scales={"o_totalprice": 100000.0, "c_acctbal": 1000.0})
    return cf


register("counterfactual_changes", "L8 B35 C5")(counterfactual_changes)


def counterfactual_frequency(spark, sf_dir):
    return counterfactual_changes(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy("n")


register("counterfactual_frequency", "D21 F-7 L8")(counterfactual_frequency)


# ------------------------------------------------------------------ L9, L10
def anchor_rules(spark, sf_dir):
    train, test, prep = _frames(spark, sf_dir)
    lab = lambda d: d.withColumn("high", encode.binary_target(Y).cast("double"))
    m = models.fit(models.learner("forest_classifier300", label="high"), lab(train))
    scored = _scorer(m, prep)(_raw_test(spark, sf_dir)).select("row_id", *NUMERIC, *CATEGORICAL, "prediction")
    pick = split.sample_n(scored, 12, "row_id", seed=42).select("row_id")
    return explain.local_rules(scored, "row_id", pick, NUMERIC, CATEGORICAL)


register("anchor_rules", "L9 B23")(anchor_rules)


def _rule_class():
    return (F.col(Y) >= 2.5).cast("int").alias("prediction")


def anchor_rules_given(spark, sf_dir):
    """L9 given predictions: the class is the target's side of 2.5, the 40
    orders with the least hash are explained."""
    scored = fx.signal(spark, sf_dir).select("row_id", *NUMERIC, *CATEGORICAL, _rule_class())
    pick = split.sample_n(scored, 40, "row_id", seed=9).select("row_id")
    out = explain.local_rules(scored, "row_id", pick, NUMERIC, CATEGORICAL)
    return out.select("row_id", "rule", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


def _anchor_sql() -> str:
    feats = NUMERIC + CATEGORICAL
    sets = [s for k in (1, 2, 3) for s in itertools.combinations(range(1, len(feats) + 1), k)]
    cuts = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q{i}" for i, c in enumerate(NUMERIC))

    def cut(i: int, c: str) -> str:
        g = [f"printf('%g', q{i}[{k}])" for k in (1, 2, 3)]
        return (f"CASE WHEN {c} <= q{i}[1] THEN '{c} <= ' || {g[0]} WHEN {c} <= q{i}[2] THEN {g[0]} || ' < {c} <= ' || {g[1]} "
                f"WHEN {c} <= q{i}[3] THEN {g[1]} || ' < {c} <= ' || {g[2]} ELSE '{c} > ' || {g[2]} END")

    preds = ", ".join([cut(i, c) for i, c in enumerate(NUMERIC)] + [f"'{c} = ' || {c}" for c in CATEGORICAL])
    return f"""
, q AS (SELECT {cuts} FROM signal),
p AS (SELECT row_id, CAST({Y} >= 2.5 AS INT) AS t, [{preds}] AS p FROM signal, q),
s(id, idx) AS (VALUES {', '.join(f'({i}, {list(x)})' for i, x in enumerate(sets))}),
r AS (SELECT row_id, t, id, array_to_string(list_transform(idx, lambda i: p[i]), ' AND ') AS txt, len(idx) AS k FROM p, s),
c AS (SELECT id, txt, t, count(*) AS n FROM r GROUP BY ALL),
x AS (SELECT row_id FROM signal ORDER BY {uniform_sql('9', 'row_id')}, row_id LIMIT 40),
m AS (SELECT r.row_id, r.id, r.k, r.txt, r.t, sum(n) AS cov, coalesce(sum(CASE WHEN c.t = r.t THEN n END), 0) AS hit
      FROM r SEMI JOIN x USING (row_id) JOIN c USING (id, txt) GROUP BY ALL),
f AS (SELECT *, hit / cov AS prec, cov / (SELECT count(*) FROM signal) AS coverage FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY prec >= 0.9 DESC, CASE WHEN prec >= 0.9 THEN coverage END DESC NULLS LAST,
             prec DESC, k, id) AS nth FROM f)
SELECT row_id, 'IF ' || txt || ' THEN ' || t AS rule, round(prec, 6) AS precision, round(coverage, 6) AS coverage FROM o WHERE nth = 1"""


register("anchor_rules_given", "L9 B23", fx.with_views(_anchor_sql(), "signal").replace("\n\n, q AS", ",\nq AS"))(anchor_rules_given)


def surrogate_tree_rules(spark, sf_dir):
    train, test, prep = _frames(spark, sf_dir)
    lab = lambda d: d.withColumn("high", encode.binary_target(Y).cast("double"))
    m = models.fit(models.learner("forest_classifier300", label="high"), lab(train))
    preds = m.transform(lab(train)).select("features", F.col("prediction").alias("model_label"))
    tree = models.fit(models.learner("tree_classifier_d4", label="model_label"), preds)
    return explain.surrogate_rules(spark, tree, prep.feature_names)


register("surrogate_tree_rules", "L10 K3")(surrogate_tree_rules)


# ------------------------------------------------------------------ D25
def bootstrap_importance_sd(spark, sf_dir, replicates: int = 8):
    """Sd over bootstrap replicates of a boosted model's importances;
    each replicate refits with Poisson(1) row weights (``weightCol``), so no
    rows are copied."""
    train, _, prep = _frames(spark, sf_dir)
    names = prep.feature_names

    def replicate(b: int):
        w = split.bootstrap_weights(train.select("row_id", Y, "features"), "row_id", 1, seed=1000 + b)
        m = models.fit(GBTRegressor(maxIter=20, maxDepth=4, seed=42, labelCol=Y), w, weight="w")
        return models.importances_table(spark, {f"b{b}": m}, names).withColumn("b", F.lit(b))

    with ThreadPool(4) as pool:  # replicates are independent runs of many small jobs
        reps = pool.map(inheritable_thread_target(spark)(replicate), range(1, replicates + 1))
    allr = reps[0]
    for r_ in reps[1:]:
        allr = allr.unionByName(r_)
    return allr.groupBy("feature").agg(F.avg("importance").alias("importance_mean"),
                                       F.stddev_pop("importance").alias("importance_sd"))


register("bootstrap_importance_sd", "D25 H5 K2")(bootstrap_importance_sd)
