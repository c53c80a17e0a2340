"""Cleaning, recoding, straight-line screening and group splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import clean, groups
from panelkit.plans.registry import register
from panelkit.sources import fixtures as fx

INTRO_MAP = {"ambiguous": "ambiguous", "ambigious": "ambiguous", "boasting": "boasting"}
CELL = ["participant", "introduction", "scenario"]


def clean_ratings(spark, sf_dir):
    """Shared cleaning: null drop on needed columns, B9 normalise, B12 cast."""
    r = fx.ratings(spark, sf_dir)
    r = clean.drop_missing(r, ["participant", "introduction_raw", "scenario", "quality", "rating"])
    r = clean.recode(r, "introduction_raw", INTRO_MAP, unmapped="null", lower=True, out="introduction")
    return clean.to_number(r, ["quality", "rating"])


CLEAN_SQL = """
clean AS (
  SELECT *, CASE lower(introduction_raw) WHEN 'ambiguous' THEN 'ambiguous' WHEN 'ambigious' THEN 'ambiguous'
                 WHEN 'boasting' THEN 'boasting' END AS introduction
  FROM ratings
  WHERE participant IS NOT NULL AND introduction_raw IS NOT NULL AND scenario IS NOT NULL
    AND quality IS NOT NULL AND rating IS NOT NULL AND NOT isnan(quality) AND NOT isnan(rating))"""

FLAGS_SQL = """
counts AS (SELECT participant, introduction, scenario, rating, count(*) AS n FROM clean GROUP BY 1, 2, 3, 4),
marked AS (SELECT *, CASE WHEN n >= 7 AND n < 14 THEN n END AS mid FROM counts),
lagged AS (SELECT *, lag(mid) OVER (PARTITION BY participant, introduction, scenario
                                    ORDER BY mid DESC NULLS LAST) AS prev FROM marked),
flags AS (SELECT participant, introduction, scenario,
                 max(n) >= 14 OR bool_or(mid IS NOT NULL AND prev IS NOT NULL AND abs(prev - mid) <= 1)
                 AS equal_response
          FROM lagged GROUP BY 1, 2, 3)"""


def _with(sql_tail: str, *extra_ctes: str, views=("ratings",)) -> str:
    body = fx.with_views("SELECT 1", *views)[: -len("\nSELECT 1")]
    ctes = ",".join((CLEAN_SQL,) + extra_ctes)
    return f"{body},{ctes}\n{sql_tail}"


# --------------------------------------------------------------------------- flagship
def straightline_cells(spark, sf_dir):
    """Flagship: clean -> D3 -> D4 -> tag -> per (cell, flag) summary and
    quality slope. Answers whether quality moves the rating once
    straight-liners are set apart."""
    r = clean_ratings(spark, sf_dir)
    tagged = groups.tag_equal_response(r, CELL, "rating")
    out = tagged.groupBy("introduction", "scenario", "equal_response").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("rating"), 6).alias("mean_rating"),
        F.round(F.stddev_samp("rating"), 6).alias("sd_rating"),
        F.round(F.regr_slope("rating", "quality"), 6).alias("slope"),
        F.round(F.regr_r2("rating", "quality"), 6).alias("r2"),
    )
    return out


register("straightline_cells", "A1 B1 B9 B12 D3 D4 C1 C2 D1 J12", _with("""
SELECT c.introduction, c.scenario, coalesce(f.equal_response, false) AS equal_response,
       count(*) AS n, round(avg(rating), 6) AS mean_rating, round(stddev_samp(rating), 6) AS sd_rating,
       round(regr_slope(rating, quality), 6) AS slope, round(regr_r2(rating, quality), 6) AS r2
FROM clean c LEFT JOIN flags f
  ON c.participant = f.participant AND c.introduction = f.introduction AND c.scenario = f.scenario
GROUP BY 1, 2, 3""", FLAGS_SQL))(straightline_cells)
