"""Metric queries over the proxy scored table and the rating table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import encode, metrics
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx

K = 5


def _scored(spark, sf_dir):
    s = fx.scored(spark, sf_dir)
    return s.withColumn("y_pred", metrics.argmax_class("probs"))


def _r6(df):
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql(tail: str, *views: str) -> str:
    return fx.with_views(tail, *views)


# ------------------------------------------------------------------ D8
def regression_scores(spark, sf_dir):
    r = fx.ratings(spark, sf_dir).withColumn("pred", F.lit(3.0) + (F.col("quality") - 76.5) / 20.0)
    return _r6(metrics.regression_metrics(r, "rating", "pred", by=["scenario"]))


register("regression_scores", "D8", _sql("""
SELECT scenario, count(*) AS n,
       round(avg(abs(rating - (3.0 + (quality - 76.5) / 20.0))), 6) AS mae,
       round(avg((rating - (3.0 + (quality - 76.5) / 20.0)) * (rating - (3.0 + (quality - 76.5) / 20.0))), 6) AS mse,
       round(sqrt(avg((rating - (3.0 + (quality - 76.5) / 20.0)) * (rating - (3.0 + (quality - 76.5) / 20.0)))), 6) AS rmse,
       round(1 - avg((rating - (3.0 + (quality - 76.5) / 20.0)) * (rating - (3.0 + (quality - 76.5) / 20.0)))
                 / var_pop(rating), 6) AS r2
FROM ratings GROUP BY scenario""", "ratings"))(regression_scores)


# ------------------------------------------------------------------ B34 + D9
QUANTILES = (0.25, 0.5, 0.75)


def quantile_scores(spark, sf_dir):
    r = fx.ratings(spark, sf_dir).withColumn(
        "qpred", F.array(F.col("rating") - 0.5, F.lit(3.0) + (F.col("quality") - 76.5) / 20.0, F.col("rating") + 0.25))
    long = encode.unpivot_quantiles(r, "qpred", QUANTILES, keep=["row_id", "rating"])
    return _r6(metrics.quantile_mae(long, "rating"))


register("quantile_scores", "B34 D9", _sql("""
SELECT quantile, round(avg(abs(rating - prediction)), 6) AS mae FROM (
  SELECT CAST(0.25 AS DOUBLE) AS quantile, rating, rating - 0.5 AS prediction FROM ratings
  UNION ALL SELECT 0.5, rating, 3.0 + (quality - 76.5) / 20.0 FROM ratings
  UNION ALL SELECT 0.75, rating, rating + 0.25 FROM ratings) t
GROUP BY quantile""", "ratings"))(quantile_scores)


# ------------------------------------------------------------------ D10
def classification_scores(spark, sf_dir):
    return _r6(metrics.macro_scores(_scored(spark, sf_dir), "y_true", "y_pred", K))


PER_CLASS_SQL = """
cls AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) v(cls)),
cnt AS (
  SELECT c.cls,
         CAST(coalesce(sum(CASE WHEN s.y_true = c.cls AND s.y_pred = c.cls THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
         CAST(coalesce(sum(CASE WHEN s.y_true <> c.cls AND s.y_pred = c.cls THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
         CAST(coalesce(sum(CASE WHEN s.y_true = c.cls AND s.y_pred <> c.cls THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn,
         CAST(coalesce(sum(CASE WHEN s.y_true = c.cls THEN 1 ELSE 0 END), 0) AS BIGINT) AS support
  FROM cls c CROSS JOIN scored s GROUP BY c.cls)"""


register("classification_scores", "D10", _sql(f"""
, {PER_CLASS_SQL.strip()}
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(avg(CASE WHEN tp + fp + fn > 0 THEN coalesce(tp / nullif(tp + fn, 0), 0) END), 6) AS macro_accuracy,
       round(avg(CASE WHEN tp + fp + fn > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END), 6) AS macro_f1
FROM cnt""", "scored").replace("\n, cls AS", ",\ncls AS"))(classification_scores)


# ------------------------------------------------------------------ D14
def per_class_scores(spark, sf_dir):
    return _r6(metrics.per_class_report(_scored(spark, sf_dir), "y_true", "y_pred", K))


register("per_class_scores", "D14", _sql(f"""
, {PER_CLASS_SQL.strip()}
SELECT CAST(cls AS INT) AS cls, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, support
FROM cnt""", "scored").replace("\n, cls AS", ",\ncls AS"))(per_class_scores)


# ------------------------------------------------------------------ D11
def confusion_shares(spark, sf_dir):
    return _r6(metrics.confusion(_scored(spark, sf_dir), "y_true", "y_pred", K, normalize="pred"))


register("confusion_shares", "D11", _sql("""
, cls AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) v(c)),
grid AS (SELECT a.c AS y_true, b.c AS y_pred FROM cls a CROSS JOIN cls b),
cells AS (SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY 1, 2),
full_ AS (SELECT g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS count
          FROM grid g LEFT JOIN cells c ON g.y_true = c.y_true AND g.y_pred = c.y_pred)
SELECT CAST(y_true AS INT) AS y_true, CAST(y_pred AS INT) AS y_pred, count,
       round(coalesce(count / nullif(sum(count) OVER (PARTITION BY y_pred), 0), 0), 6) AS share
FROM full_""", "scored").replace("\n, cls AS", ",\ncls AS"))(confusion_shares)


# ------------------------------------------------------------------ D12
def kappa_score(spark, sf_dir):
    return _r6(metrics.quadratic_kappa(_scored(spark, sf_dir), "y_true", "y_pred", K))


register("kappa_score", "D12", _sql("""
, cells AS (SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY 1, 2),
r AS (SELECT y_true, sum(n) AS rn FROM cells GROUP BY 1),
c AS (SELECT y_pred, sum(n) AS cn FROM cells GROUP BY 1),
t AS (SELECT sum(n) AS total FROM cells),
o AS (SELECT sum((y_true - y_pred) * (y_true - y_pred) * n) AS wo FROM cells),
e AS (SELECT sum((r.y_true - c.y_pred) * (r.y_true - c.y_pred) * rn * cn / total) AS we FROM r, c, t)
SELECT round(1 - wo / we, 6) AS qwk FROM o, e""", "scored").replace("\n, cells AS", ",\ncells AS"))(kappa_score)


# ------------------------------------------------------------------ D13 + B26
CLASS_VALUES = [1.0, 2.0, 3.0, 4.0, 5.0]


def class_value_error(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("y_value", encode.class_value("y_true", CLASS_VALUES))
    return _r6(metrics.class_value_mae(s, "y_value", "y_pred", CLASS_VALUES))


register("class_value_error", "D13 B26", _sql("""
SELECT round(avg(abs((y_pred + 1.0) - (y_true + 1.0))), 6) AS mae_value FROM scored""", "scored"))(class_value_error)


# ------------------------------------------------------------------ D15
def calibration_table(spark, sf_dir):
    return _r6(metrics.calibration_bins(_scored(spark, sf_dir), "y_true", "probs"))


register("calibration_table", "D15", _sql("""
SELECT CAST(least(9, floor(wmax / wsum * 10)) AS INT) AS bin, count(*) AS count,
       round(avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(wmax / wsum), 6) AS confidence
FROM scored GROUP BY 1""", "scored"))(calibration_table)


def calibration_error(spark, sf_dir):
    return _r6(metrics.ece(_scored(spark, sf_dir), "y_true", "probs"))


register("calibration_error", "D15", _sql("""
, bins AS (SELECT least(9, floor(wmax / wsum * 10)) AS bin, count(*) AS n,
                 avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS acc, avg(wmax / wsum) AS conf
          FROM scored GROUP BY 1)
SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM bins""", "scored")
         .replace("\n, bins AS", ",\nbins AS"))(calibration_error)


# ------------------------------------------------------------------ D16
def cross_entropy_score(spark, sf_dir):
    return _r6(metrics.cross_entropy(_scored(spark, sf_dir), "y_true", "probs"))


register("cross_entropy_score", "D16", _sql("""
SELECT round(-avg(ln(CASE y_true WHEN 0 THEN w0 WHEN 1 THEN w1 WHEN 2 THEN w2 WHEN 3 THEN w3 ELSE w4 END
                   / wsum)), 6) AS cross_entropy
FROM scored""", "scored"))(cross_entropy_score)
