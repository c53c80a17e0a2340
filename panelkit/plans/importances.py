"""Importance-table queries over the proxy importance and node tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import importance
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx

PARENTS = ["F", "O", "P"]
MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _r(df, d=6):
    return df.select(*[F.round(F.col(c), d).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _consolidated(spark, sf_dir):
    imp = fx.importances(spark, sf_dir).withColumn("feature", F.concat(F.lit("cat__"), F.col("feature")))
    return importance.consolidate(imp, PARENTS)


CONS_SQL = """
, cons AS (SELECT split_part(feature, '_', 1) AS feature, model, sum(importance) AS importance
           FROM importances GROUP BY 1, 2),
norm AS (SELECT feature, model, greatest(importance, 0) / sum(greatest(importance, 0)) OVER (PARTITION BY model)
                AS importance FROM cons)"""


def importance_normalized(spark, sf_dir):
    n = importance.normalize(_consolidated(spark, sf_dir))
    return _r(importance.rank_table(n).select("feature", "model", "importance", "rank"))


register("importance_normalized", "D17 D18 B27 E2", fx.with_views(CONS_SQL + """
SELECT feature, model, round(importance, 6) AS importance,
       CAST(rank() OVER (PARTITION BY model ORDER BY importance DESC) AS INT) AS rank FROM norm""", "importances")
         .replace("\n, cons AS", ",\ncons AS"))(importance_normalized)


def importance_stability(spark, sf_dir):
    n = importance.normalize(_consolidated(spark, sf_dir))
    t = importance.rank_table(n)
    return _r(t.groupBy("feature").agg(F.first("mean_importance").alias("mean_importance"),
                                       F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"))
              .orderBy(F.col("mean_importance").desc(), "feature"))


register("importance_stability", "L11 L12 D26 E2", fx.with_views(CONS_SQL + """,
rk AS (SELECT feature, importance, rank() OVER (PARTITION BY model ORDER BY importance DESC) AS rank FROM norm)
SELECT feature, round(avg(importance), 6) AS mean_importance, CAST(min(rank) AS INT) AS best_rank,
       CAST(max(rank) AS INT) AS worst_rank
FROM rk GROUP BY feature ORDER BY mean_importance DESC, feature""", "importances")
         .replace("\n, cons AS", ",\ncons AS"))(importance_stability)


def importance_pivot(spark, sf_dir):
    n = importance.normalize(_consolidated(spark, sf_dir))
    return _r(importance.pivot_models(n, MODELS))


register("importance_pivot", "D22", fx.with_views(CONS_SQL + "\nSELECT feature, " + ", ".join(
    f"round(coalesce(sum(CASE WHEN model = '{m}' THEN importance END), 0.0), 6) AS \"{m}\"" for m in MODELS)
    + " FROM norm GROUP BY feature", "importances").replace("\n, cons AS", ",\ncons AS"))(importance_pivot)


def importance_spread(spark, sf_dir):
    nd = fx.nodes(spark, sf_dir)
    a = importance.spread_over_trees(nd, sd="samp")
    b = importance.spread_over_trees(nd, sd="pop", n_trees=25)
    return _r(a.join(b.drop("total_gain"), "feature"), 2)


register("importance_spread", "D19", fx.with_views("""
, per AS (SELECT tree, feature, sum(gain) AS g FROM nodes GROUP BY 1, 2),
t AS (SELECT count(DISTINCT tree) AS nt FROM nodes),
a AS (SELECT feature, sum(g) AS total_gain, sum(g * g) AS s2 FROM per GROUP BY 1)
SELECT feature, round(total_gain, 2) AS total_gain,
       round(sqrt(greatest(s2 - nt * (total_gain / nt) * (total_gain / nt), 0) / (nt - 1)), 2) AS sd_samp,
       round(sqrt(greatest(s2 - 25 * (total_gain / 25) * (total_gain / 25), 0) / 25), 2) AS sd_pop
FROM a, t""", "nodes").replace("\n, per AS", ",\nper AS"))(importance_spread)
