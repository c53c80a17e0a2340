"""Explainability tables (survey L2-L10, D20, D21, F12).

Model-agnostic operators take a *scorer*: any function ``DataFrame ->
DataFrame`` that adds a ``prediction`` column and keeps the input columns.
Perturbed copies of rows are built with explode/cross joins and scored in one
job; nothing loops over jobs per feature or per row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators import permute, ranks, split

Scorer = Callable[[DataFrame], DataFrame]


# ------------------------------------------------------------------ L2 permutation importance
def permutation_importance(scorer: Scorer, df: DataFrame, key: str, y: str, features: Sequence[str],
                           repeats: int = 30, seed: int = 42) -> DataFrame:
    """Per feature, mean and population sd over ``repeats`` of
    (MAE with the feature permuted - base MAE).

    Rows are numbered once and written in blocks; the values of all copies meet
    them packed (:mod:`panelkit.operators.permute`). A scorer with a method ``table``
    (the predictions of all combinations of codes of its columns) is looked up,
    others score the copies."""
    features = list(features)
    coded = scorer.table(df, y, features, key) if hasattr(scorer, "table") else None
    blocks = permute.permuted(coded[0] if coded else df, key, coded[1] if coded else features, repeats, seed)
    if blocks is None:
        return _joined_importance(scorer, df, key, y, features, repeats, seed)
    if coded:
        errors = blocks.table_errors(y, *coded[2:]).groupBy("__copy").agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("__mae"))
    else:
        errors = scorer(blocks.copies()).groupBy("__copy").agg(F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("__mae"))
    base = F.col("__copy") == len(features) * repeats
    one = errors.agg(F.max(F.when(base, F.col("__mae"))).alias("__base"), F.collect_list(F.when(~base, F.struct("__copy", "__mae"))).alias("__all"))
    name = F.element_at(F.lit(features), (F.floor(F.col("__copy") / repeats) + 1).cast("int"))
    d = one.select("__base", F.inline("__all")).select(name.alias("feature"), (F.col("__mae") - F.col("__base")).alias("__d"))
    return d.groupBy("feature").agg(F.avg("__d").alias("importance_mean"), F.stddev_pop("__d").alias("importance_sd"))


def _joined_importance(scorer: Scorer, df: DataFrame, key: str, y: str, features: list, repeats: int, seed: int) -> DataFrame:
    """The same for rows that cannot travel packed: every row sends the one value
    of each (feature, repeat) to the row that a keyed bijection of its number
    names, so what is shuffled per copy is a number and a value, never a row."""
    rows = split.numbered_rows(df, key)
    combos = F.broadcast(split.permutation_combos(df.sparkSession, features, repeats, seed))  # features x repeats rows
    value = F.struct(*[F.when(F.col("feature") == f, F.col(f)).alias(f) for f in features]).alias("__src")
    sent = split.with_bijection(rows.crossJoin(combos).select("feature", "repeat", "__keys", "__i", value), "__i", rows.count(), "__keys", "__i").drop("__keys")
    x = sent.join(rows.hint("shuffle_hash"), "__i").drop("__i")  # numbers are unique and even; the copies need no sort
    for f in features:
        x = x.withColumn(f, F.when(F.col("feature") == f, F.col(f"__src.{f}")).otherwise(F.col(f)))
    perm = scorer(x.drop("__src")).groupBy("feature", "repeat").agg(F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("__mae"))
    base = scorer(rows.drop("__i")).agg(F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("__base"))
    d = perm.crossJoin(F.broadcast(base)).withColumn("__d", F.col("__mae") - F.col("__base"))
    return d.groupBy("feature").agg(F.avg("__d").alias("importance_mean"), F.stddev_pop("__d").alias("importance_sd"))


# ------------------------------------------------------------------ L6 partial dependence + ICE
def pdp_ice(scorer: Scorer, df: DataFrame, feature: str, key: str, by: Sequence[str] = (), points: int = 30,
            lo_q: float = 0.05, hi_q: float = 0.95, sample_per_cell: int | None = 200, seed: int = 42
            ) -> tuple[DataFrame, DataFrame]:
    """Grid of ``points`` values between the ``lo_q`` and ``hi_q``
    percentiles of ``feature``; ICE = every (sampled) row scored at every
    grid value; PDP = mean ICE per (cell, grid point). Returns (pdp, ice).

    A scorer with a method ``counted`` (rows it scores alike, with their number
    ``__n``) is asked once per such rows for the PDP of all rows."""
    by = list(by)
    q = ranks.exact_percentile(df, feature, [lo_q, hi_q])
    rng = q.agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    grid = (df.sparkSession.range(points).withColumnRenamed("id", "grid_index").crossJoin(F.broadcast(rng))
            .select("grid_index", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("grid_index")
                                   / (points - 1)).alias("__g")))
    rows = split.sample_n(df, sample_per_cell, key, by=by, seed=seed) if sample_per_cell else df
    x = rows.crossJoin(F.broadcast(grid)).withColumn(feature, F.col("__g"))  # rows x points (bounded grid)
    ice = scorer(x).select(key, *by, "grid_index", F.col("__g").alias("grid_value"), "prediction")
    cell = [*by, "grid_index", "grid_value"]
    if sample_per_cell or not hasattr(scorer, "counted"):
        return ice.groupBy(*cell).agg(F.avg("prediction").alias("partial_dependence")), ice
    few = scorer(scorer.counted(df, feature, by).crossJoin(F.broadcast(grid)).withColumn(feature, F.col("__g")))
    mean = F.sum(F.col("prediction") * F.col("__n")) / F.sum("__n")
    return few.withColumn("grid_value", F.col("__g")).groupBy(*cell).agg(mean.alias("partial_dependence")), ice


# ------------------------------------------------------------------ L3 / L4 / L5 tree Shapley
def _tree_arrays(nodes: pd.DataFrame):
    trees = []
    for t, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        cats = [None if c is None else np.asarray(c, float) for c in g["left_categories"]]
        trees.append((g["left"].tolist(), g["right"].tolist(), g["feature"].tolist(), g["threshold"].tolist(), cats,
                      g["value"].tolist(), g["cover"].tolist(), float(g["weight"].iloc[0])))
    return trees


def _leaves(tree):
    """Per leaf: (value x weight, its path's distinct features, z per feature,
    splits per feature). z is the product of the cover shares of the
    feature's splits; splits are (node, goes left)."""
    left, right, feat, _, _, val, cover, wt = tree
    stack = [(0, {})]
    while stack:
        j, path = stack.pop()
        if left[j] < 0:
            feats = list(path)
            yield val[j] * wt, feats, np.array([path[f][0] for f in feats]), [path[f][1] for f in feats]
            continue
        for child, is_left in ((left[j], True), (right[j], False)):
            z, splits = path.get(feat[j], (1.0, []))
            stack.append((child, {**path, feat[j]: (z * cover[child] / cover[j], [*splits, (j, is_left)])}))


def _goes_left(x: np.ndarray, tree) -> dict[int, np.ndarray]:
    """Which rows every split node sends left."""
    left, _, feat, thr, cats, _, _, _ = tree
    return {j: np.isin(x[:, feat[j]], cats[j]) if cats[j] is not None else x[:, feat[j]] <= thr[j]
            for j in range(len(left)) if left[j] >= 0}


#: Features on a path up to which all their patterns are listed.
_BITS = 6


def _patterns(x: np.ndarray, trees):
    """For every leaf with a path: (value, features, z, patterns of followed
    features, pattern number of every row). A pattern is a number with one bit
    per feature; up to ``_BITS`` features all patterns are listed, beyond
    that those that occur."""
    for tree in trees:
        went = _goes_left(x, tree)
        for value, feats, z, splits in _leaves(tree):
            if not feats:
                continue
            row = np.zeros(len(x), np.int64)
            for i, part in enumerate(splits):
                follows = np.logical_and.reduce([went[j] if is_left else ~went[j] for j, is_left in part])
                row |= follows.astype(np.int64) << i
            seen = np.arange(1 << len(feats))
            if len(feats) > _BITS:
                seen, row = np.unique(row, return_inverse=True)
            yield value, feats, z, (seen[:, None] >> np.arange(len(feats)) & 1).astype(float), row.ravel()


def _subset_sums(o: np.ndarray, z: np.ndarray, without: tuple[int, ...]) -> np.ndarray:
    """Column k: sum over subsets S of size k of the other features of
    prod(o in S) prod(z outside S), by multiplying out (z + o t)."""
    c = np.ones((len(o), 1))
    for j in range(len(z)):
        if j not in without:
            c = np.pad(c * z[j], ((0, 0), (0, 1))) + np.pad(c * o[:, j:j + 1], ((0, 0), (1, 0)))
    return c


def tree_shap(x: np.ndarray, trees, n_feat: int) -> np.ndarray:
    """Exact path-dependent Shapley values, rows x features, of all trees.

    A leaf's share depends on a row only through which of its path's features
    the row follows, so it is computed once per distinct pattern and spread
    over the batch."""
    phi = np.zeros((len(x), n_feat))
    for value, feats, z, o, row in _patterns(x, trees):
        d = len(feats)
        w = np.array([math.factorial(k) * math.factorial(d - k - 1) for k in range(d)]) / math.factorial(d)
        for i, f in enumerate(feats):
            phi[:, f] += (value * (o[:, i] - z[i]) * (_subset_sums(o, z, (i,)) @ w))[row]
    return phi


def tree_interactions(x: np.ndarray, trees) -> dict[tuple[int, int], np.ndarray]:
    """Exact Shapley interaction values per feature pair a < b that shares a
    path; all other pairs are 0."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for value, feats, z, o, row in _patterns(x, trees):
        d = len(feats)
        if d < 2:
            continue
        w = np.array([math.factorial(k) * math.factorial(d - k - 2) for k in range(d - 1)]) / (2 * math.factorial(d - 1))
        for i, j in itertools.combinations(range(d), 2):
            part = value * (o[:, i] - z[i]) * (o[:, j] - z[j]) * (_subset_sums(o, z, (i, j)) @ w)
            pair = (min(feats[i], feats[j]), max(feats[i], feats[j]))
            out[pair] = out.get(pair, 0.0) + part[row]
    return out


def expected_value(trees) -> float:
    tot = 0.0
    for left, _, _, _, _, val, cover, wt in trees:
        root = cover[0]
        tot += wt * sum(cover[i] / root * val[i] for i in range(len(left)) if left[i] < 0)
    return tot


def shapley(df: DataFrame, nodes: DataFrame, key: str, features: str = "features",
            feature_names: Sequence[str] | None = None, base: float = 0.0) -> DataFrame:
    """L3: exact tree Shapley attributions, one row per (row, feature).

    The node table (model-sized) is shipped to the tasks; rows stream through
    ``mapInPandas`` in Arrow batches. ``base`` is added to the expected value
    (e.g. a boosted model's initial prediction offset, 0 for MLlib).
    Additivity: ``sum(shap) + expected_value = prediction``.
    """
    trees = _tree_arrays(nodes.toPandas())  # model-sized, not data-sized
    n_feat = int(nodes.agg(F.max("feature")).first()[0]) + 1
    if feature_names is not None:
        n_feat = max(n_feat, len(feature_names))
    names = list(feature_names) if feature_names is not None else [f"f{i}" for i in range(n_feat)]
    ev = expected_value(trees) + base

    def run(it):
        for pdf in it:
            x = np.array(pdf["__x"].tolist(), float).reshape(len(pdf), -1)
            phi = tree_shap(x, trees, n_feat)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), n_feat), "feature": names[:n_feat] * len(pdf),
                                "shap": phi.ravel(), "expected_value": ev})

    key_t = df.schema[key].dataType.simpleString()
    src = df.select(key, vector_to_array(features).alias("__x"))
    return src.mapInPandas(run, f"{key} {key_t}, feature string, shap double, expected_value double")


def shapley_interactions(df: DataFrame, nodes: DataFrame, key: str, features: str = "features",
                         feature_names: Sequence[str] | None = None) -> DataFrame:
    """L4: tree Shapley interaction values per row and feature pair i < j:
    ``(phi_j | i present - phi_j | i absent) / 2``."""
    trees = _tree_arrays(nodes.toPandas())
    n_feat = int(nodes.agg(F.max("feature")).first()[0]) + 1
    if feature_names is not None:
        n_feat = max(n_feat, len(feature_names))
    names = list(feature_names) if feature_names is not None else [f"f{i}" for i in range(n_feat)]
    used = sorted({f for t in trees for f in t[2] if f >= 0})

    def run(it):
        for pdf in it:
            x = np.array(pdf["__x"].tolist(), float).reshape(len(pdf), -1)
            found = tree_interactions(x, trees)
            for a, b in itertools.combinations(used, 2):
                yield pd.DataFrame({key: pdf[key].to_numpy(), "feature_a": names[a], "feature_b": names[b],
                                    "interaction": found.get((a, b), np.zeros(len(pdf)))})

    key_t = df.schema[key].dataType.simpleString()
    src = df.select(key, vector_to_array(features).alias("__x"))
    return src.mapInPandas(run, f"{key} {key_t}, feature_a string, feature_b string, interaction double")


def mean_abs(long: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean absolute attribution (or interaction) per feature (pair)."""
    return long.groupBy(*by).agg(F.avg(F.abs(F.col(value))).alias(f"mean_abs_{value}"))


def top_pairs(inter: DataFrame, k: int = 15) -> DataFrame:
    """L4/F-2: top ``k`` pairs by mean absolute interaction."""
    m = mean_abs(inter, "interaction", ["feature_a", "feature_b"])
    return m.orderBy(F.col("mean_abs_interaction").desc(), "feature_a", "feature_b").limit(k)


def moderation(shap_long: DataFrame, rows: DataFrame, key: str, feature: str, value_col: str, by: str) -> DataFrame:
    """Attribution of ``feature`` against its value, per level of ``by``:
    mean attribution, slope and n (joined on the row identity, C7)."""
    s = shap_long.where(F.col("feature") == feature).select(key, "shap")
    j = s.join(rows.select(key, value_col, by), key)
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("shap").alias("mean_shap"),
                             F.regr_slope("shap", value_col).alias("slope"))


# ------------------------------------------------------------------ L8 counterfactuals
def _changed(rows: DataFrame, features: Sequence[str], scales: dict) -> DataFrame:
    """Apply the changes in ``__chg``; originals stay as ``__orig_*``, ``__dist``
    is the normalised distance and ``__n`` the number of changes."""
    types, dist = dict(rows.dtypes), F.lit(0.0)
    for f in features:
        hit = F.filter("__chg", lambda s: s["feature"] == F.lit(f))  # noqa: B023
        new = F.when(F.size(hit) > 0, F.element_at(hit, 1)["value"].cast(types[f]))
        rows = rows.withColumn(f"__orig_{f}", F.col(f)).withColumn(f, F.coalesce(new, F.col(f)))
        if scales.get(f):
            dist = dist + F.abs(F.col(f).cast("double") - F.col(f"__orig_{f}").cast("double")) / F.lit(float(scales[f]))
        else:
            dist = dist + (~F.col(f).cast("string").eqNullSafe(F.col(f"__orig_{f}").cast("string"))).cast("double")
    return rows.withColumn("__dist", dist).withColumn("__n", F.size("__chg"))


def counterfactuals(scorer: Scorer, df: DataFrame, key: str, features: Sequence[str], candidates: DataFrame,
                    is_target: Callable, n_rows: int = 8, per_row: int = 2, max_changes: int | None = None,
                    select_rows: Callable | None = None, seed: int = 42, scales: dict | None = None) -> DataFrame:
    """For ``n_rows`` hash-chosen rows (optionally pre-filtered by
    ``select_rows``) the ``per_row`` minimal changes to candidate values
    (``candidates``: feature, value as string) for which
    ``is_target(prediction)`` holds: fewest changed features, then smallest
    normalised distance. Long table (sample_id, cf_id, feature, original,
    counterfactual).

    Best-first by the number of changes: a frontier table holds the change sets
    of one size for the rows that have too few counterfactuals yet; a round
    scores it in one job, drops the rows that are served and extends the rest
    by one feature (features in order, so every set appears once). Up to
    ``max_changes`` features may change, all of them by default."""
    from pyspark.sql import Window

    from panelkit.session import materialize

    features = list(features)
    picked = materialize(split.sample_n(select_rows(df) if select_rows else df, n_rows, key, seed=seed))
    order = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    every = candidates.where(F.col("feature").isin(features)).select(F.struct(
        order[F.col("feature")].alias("i"), "feature", F.col("value").cast("string").alias("value")).alias("c"))
    every = every.agg(F.sort_array(F.collect_set("c")).alias("__all"))  # one row: the caller's candidate values
    pool = picked.select(key).crossJoin(every)
    frontier = pool.select(key, F.explode("__all").alias("c")).select(key, F.array("c").alias("__chg"))
    found = None
    columns = [key, "__chg", "__n", "__dist", *[f"__orig_{f}" for f in features]]
    for size in range(1, (max_changes or len(features)) + 1):
        frontier = materialize(frontier)
        hits = scorer(_changed(frontier.join(picked, key), features, scales or {})).where(is_target(F.col("prediction"))).select(*columns)
        found = materialize(hits if found is None else found.unionByName(hits))
        served = found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= per_row).select(key)
        rest = frontier.join(served, key, "left_anti")
        if size == len(features) or rest.isEmpty():
            break
        last = F.element_at("__chg", -1)["i"]
        frontier = rest.join(pool, key).select(key, "__chg", F.explode(F.filter("__all", lambda c: c["i"] > last)).alias("c")) \
            .select(key, F.concat("__chg", F.array("c")).alias("__chg"))  # noqa: B023
    plain = F.transform("__chg", lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value")))
    w = Window.partitionBy(key).orderBy("__n", "__dist", F.to_json(plain))
    best = found.withColumn("cf_id", F.row_number().over(w)).where(F.col("cf_id") <= per_row)
    long = best.select(F.col(key).alias("sample_id"), "cf_id", F.explode("__chg").alias("__c"),
                       *[F.col(f"__orig_{f}").cast("string").alias(f"__o_{f}") for f in features])
    orig = F.lit(None).cast("string")
    for f in features:
        orig = F.when(F.col("__c.feature") == f, F.col(f"__o_{f}")).otherwise(orig)
    return long.select("sample_id", "cf_id", F.col("__c.feature").alias("feature"), orig.alias("original"),
                       F.col("__c.value").alias("counterfactual"))


# ------------------------------------------------------------------ L9 local rules
def predicates(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """One text column per feature: numeric features cut at their
    quartiles (one job for all), categorical ones as equalities."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in numeric]))
    cuts: dict[str, list[float]] = {c: [] for c in numeric}
    if numeric:
        q = ranks.exact_percentile(df.select(values.alias("s")).select("s.*"), "v", [0.25, 0.5, 0.75], by=["f"])
        for r in sorted(q.collect(), key=lambda r: (r["f"], r["p"])):  # 3 cut points per numeric feature
            cuts[r["f"]].append(float(r["value"]))
    out = []
    for c in numeric:
        v = F.col(c).cast("double")
        if not cuts[c]:
            out.append(F.lit(f"{c} is null").alias(c))
            continue
        c1, c2, c3 = cuts[c]
        out.append(F.when(v.isNull(), F.lit(f"{c} is null")).when(v <= c1, F.lit(f"{c} <= {c1:g}"))
                   .when(v <= c2, F.lit(f"{c1:g} < {c} <= {c2:g}")).when(v <= c3, F.lit(f"{c2:g} < {c} <= {c3:g}"))
                   .otherwise(F.lit(f"{c} > {c3:g}")).alias(c))
    return out + [F.coalesce(F.concat(F.lit(f"{c} = "), F.col(c).cast("string")), F.lit(f"{c} is null")).alias(c) for c in categorical]


def local_rules(scored: DataFrame, key: str, explain_keys: DataFrame, numeric: Sequence[str],
                categorical: Sequence[str], target: str = "prediction", precision_min: float = 0.9,
                max_terms: int = 3) -> DataFrame:
    """L9: "IF ... THEN" rules for chosen rows. Every conjunction of up to
    ``max_terms`` of the row's own predicates is scored by precision (share of
    covered rows with the row's predicted class) and coverage (share of all
    rows covered); per row the rule with the highest coverage among those with
    precision >= ``precision_min`` (else the most precise) wins.

    Rows are counted per distinct predicate profile; profiles are rolled up to
    every subset of the features that a rule may use (map-side combined), and
    the rules of the explained rows meet the counts by (subset, predicates)."""
    feats = [*numeric, *categorical]
    prof = scored.select(key, F.col(target).alias("__t"), F.array(*predicates(scored, numeric, categorical)).alias("__p"))
    counts = prof.groupBy("__p", "__t").agg(F.count(F.lit(1)).alias("__n"))
    total = prof.agg(F.count(F.lit(1)).alias("__N"))
    subsets = [s for k in range(1, max_terms + 1) for s in itertools.combinations(range(len(feats)), k)]
    chosen = F.posexplode(F.array(*[F.array(*[F.col("__p")[i] for i in s], *[F.lit(None).cast("string")] * (max_terms - len(s)))
                                    for s in subsets])).alias("rule_id", "preds")  # one array per subset, padded
    wanted = prof.join(explain_keys.select(key), key, "left_semi").select(key, F.col("__t").alias("__target"), chosen) \
        .withColumn("preds", F.array_compact("preds"))
    rolled = counts.select("__t", "__n", chosen).withColumn("preds", F.array_compact("preds"))
    rule = ["rule_id", "preds"]
    rolled = rolled.join(wanted.select(*rule).distinct(), rule, "left_semi").groupBy(*rule, "__t").agg(F.sum("__n").alias("__n"))
    agg = wanted.join(rolled, rule).groupBy(key, "rule_id", "preds", "__target").agg(
        F.sum("__n").alias("__cov"), F.sum(F.when(F.col("__t").eqNullSafe(F.col("__target")), F.col("__n"))).alias("__hit"))
    agg = agg.crossJoin(F.broadcast(total)).select(
        key, "rule_id", "preds", F.col("__target").alias("predicted"),
        (F.coalesce(F.col("__hit"), F.lit(0)) / F.col("__cov")).alias("precision"),
        (F.col("__cov") / F.col("__N")).alias("coverage"))
    from pyspark.sql import Window

    ok = F.col("precision") >= precision_min
    w = Window.partitionBy(key).orderBy(ok.desc(), F.when(ok, F.col("coverage")).desc_nulls_last(),
                                        F.col("precision").desc(), F.size("preds"), "rule_id")
    best = agg.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
    return best.select(key, F.format_string("IF %s THEN %s", F.array_join("preds", " AND "),
                                            F.col("predicted").cast("string")).alias("rule"),
                       "precision", "coverage")


# ------------------------------------------------------------------ L10 surrogate tree rules
def surrogate_rules(spark, tree_model, feature_names: Sequence[str]) -> DataFrame:
    """Every leaf of a (depth-limited) surrogate tree as one rule row
    (rule text, predicted class, samples)."""
    from panelkit.operators.models import node_rows

    rows = node_rows(tree_model)
    by_id = {r[1]: r for r in rows}
    out = []

    def walk(nid, conds):
        r = by_id[nid]
        if r[7] < 0:
            out.append((" AND ".join(conds) if conds else "TRUE", float(r[6]), float(r[5])))
            return
        name, thr, cats = feature_names[r[2]], r[3], r[10]
        if cats is not None:
            codes = ", ".join(f"{c:g}" for c in cats)
            walk(r[7], conds + [f"{name} IN ({codes})"])
            walk(r[8], conds + [f"{name} NOT IN ({codes})"])
            return
        walk(r[7], conds + [f"{name} <= {thr:.4g}"])
        walk(r[8], conds + [f"{name} > {thr:.4g}"])

    walk(0, [])
    return spark.createDataFrame(out, "rule string, predicted double, samples double")
