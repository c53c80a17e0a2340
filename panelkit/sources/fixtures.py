"""Proxy tables over the driver's TPC-H-like parquet files (FIXTURES.md section 2).

Each proxy exists twice: a Spark builder (``ratings(spark, sf_dir)``) and an
engine-neutral SQL text (``RATINGS_SQL``) that the oracle queries embed as a
CTE. Both read only the columns they need, so the parquet scans prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c):
    return F.col(c).cast("string")


# ---------------------------------------------------------------- ratings
def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating row per lineitem: participant, raw introduction, scenario,
    quality level (20 levels), half-step rating 1..5, demographics."""
    li = table(spark, sf_dir, "lineitem")
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    return li.select(
        F.concat_ws(
            "-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_suppkey"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("row_id"),
        F.concat(F.lit("P"), _s("l_suppkey")).alias("participant"),
        F.when(supp % 2 == 0, "boasting").when(F.col("l_linenumber") == 1, "ambigious")
        .otherwise("ambiguous").alias("introduction_raw"),
        F.element_at(
            F.array(*[F.lit(s) for s in ("3Spurig", "NeueMitte", "Spielstrasse", "Ueberland")]),
            (F.floor(supp / 2) % 4 + 1).cast("int"),
        ).alias("scenario"),
        (F.lit(67.0) + F.col("l_quantity").cast("int") % 20).alias("quality"),
        (F.lit(1.0) + F.floor(F.round(F.col("l_discount") * 100) * 0.8) / 2.0).alias("rating"),
        F.when(part % 97 == 0, F.lit(None)).otherwise(part % 50 + 18).alias("age"),
        F.concat(F.lit("A"), (part % 4 + 1).cast("string")).alias("gender"),
        F.concat(F.lit("A"), (part % 5 + 1).cast("string")).alias("education"),
        F.concat(F.lit("A"), (part % 6 + 1).cast("string")).alias("job"),
        # extra columns used by item-level operators (J11) and the clean steps
        F.col("l_linenumber").alias("line_no"),
        part.alias("part_key"),
    )


RATINGS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                 CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_id,
       concat('P', CAST(l_suppkey AS VARCHAR)) AS participant,
       CASE WHEN l_suppkey % 2 = 0 THEN 'boasting'
            WHEN l_linenumber = 1 THEN 'ambigious' ELSE 'ambiguous' END AS introduction_raw,
       CASE CAST(floor(l_suppkey / 2.0) AS BIGINT) % 4
            WHEN 0 THEN '3Spurig' WHEN 1 THEN 'NeueMitte'
            WHEN 2 THEN 'Spielstrasse' ELSE 'Ueberland' END AS scenario,
       CAST(67 + CAST(l_quantity AS INT) % 20 AS DOUBLE) AS quality,
       1.0 + floor(round(l_discount * 100) * 0.8) / 2.0 AS rating,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_partkey % 50 + 18 END AS age,
       concat('A', CAST(l_partkey % 4 + 1 AS VARCHAR)) AS gender,
       concat('A', CAST(l_partkey % 5 + 1 AS VARCHAR)) AS education,
       concat('A', CAST(l_partkey % 6 + 1 AS VARCHAR)) AS job,
       l_linenumber AS line_no,
       l_partkey AS part_key
FROM lineitem
"""


# ---------------------------------------------------------------- panel
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced participant x quality panel (one cell per participant); the
    cell rating is the mean rounded to quarter steps (exact in binary, so sums
    agree across engines)."""
    r = ratings(spark, sf_dir)
    return r.groupBy("participant", "quality").agg(
        F.min("scenario").alias("scenario"),
        F.min(F.when(F.col("introduction_raw") == "boasting", "boasting").otherwise("ambiguous")).alias("introduction"),
        (F.round(F.avg("rating") * 4) / 4).alias("rating"),
    )


PANEL_SQL = """
SELECT participant, min(scenario) AS scenario,
       min(CASE WHEN introduction_raw = 'boasting' THEN 'boasting' ELSE 'ambiguous' END) AS introduction,
       quality, round(avg(rating) * 4) / 4 AS rating
FROM ratings GROUP BY participant, quality
"""


# ---------------------------------------------------------------- responses
#: Responses of the questionnaire panel, as many as the reference analyses.
RESPONSES = [f"item{k:02d}" for k in range(1, 31)]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with one Likert-like column per response: the cell's mean
    score, shifted by participant and (for most) sloped on quality by
    participant, clipped to 1..5 in quarter steps."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 2 + F.col("l_linenumber") + F.col("l_orderkey")
    step = F.col("l_partkey") + F.col("l_linenumber") * 2
    # rows meet by cell with two numbers: partial averages of all responses are many times a row
    rows = li.select(F.col("l_suppkey").alias("supp"), (F.lit(67.0) + F.col("l_quantity").cast("int") % 20).alias("quality"),
                     start.alias("start"), step.alias("step")).repartition("supp", "quality")
    score = {f"s{k}": F.lit(1) + (F.col("start") + F.col("step") * k) % 5 for k in range(1, len(RESPONSES) + 1)}
    supp = F.col("supp")
    cell = rows.groupBy("supp", "quality").agg(F.count(score["s1"]).alias("n"), *[F.sum(x).alias(c) for c, x in score.items()]) \
        .withColumns({c: F.try_divide(c, "n") for c in score}).withColumns({
        "participant": F.concat(F.lit("P"), _s("supp")),
        "scenario": F.element_at(F.array(*[F.lit(s) for s in ("3Spurig", "NeueMitte", "Spielstrasse", "Ueberland")]),
                                 (F.floor(supp / 2) % 4 + 1).cast("int")),
        "introduction": F.when(supp % 2 == 0, "boasting").otherwise("ambiguous")})

    def value(k: int):
        shift = (F.col("supp") * (k + 1) % 7 - 3) / 6.0
        slope = (F.col("supp") * k % 5 - 1) / 4.0
        v = F.col(f"s{k}") + shift + (F.col("quality") - 76.5) / 10.0 * slope
        return F.round(F.least(F.lit(5.0), F.greatest(F.lit(1.0), v)) * 4) / 4

    return cell.select("participant", "quality", "scenario", "introduction",
                       *[value(k).alias(n) for k, n in enumerate(RESPONSES, 1)])


def _response_sql() -> str:
    ks = range(1, len(RESPONSES) + 1)
    means = ", ".join(f"avg(1 + (l_partkey * {k + 2} + l_linenumber * {2 * k + 1} + l_orderkey) % 5) AS s{k}" for k in ks)
    values = ", ".join(f"round(least(5.0, greatest(1.0, s{k} + (supp * {k + 1} % 7 - 3) / 6.0::DOUBLE"
                       f" + (quality - 76.5::DOUBLE) / 10.0::DOUBLE * ((supp * {k} % 5 - 1) / 4.0::DOUBLE))) * 4) / 4 AS {n}" for k, n in enumerate(RESPONSES, 1))
    return f"""
SELECT participant, quality, scenario, introduction, {values}
FROM (SELECT concat('P', CAST(l_suppkey AS VARCHAR)) AS participant, CAST(67 + CAST(l_quantity AS INT) % 20 AS DOUBLE) AS quality,
             min(l_suppkey) AS supp,
             min(CASE CAST(floor(l_suppkey / 2.0) AS BIGINT) % 4 WHEN 0 THEN '3Spurig' WHEN 1 THEN 'NeueMitte'
                 WHEN 2 THEN 'Spielstrasse' ELSE 'Ueberland' END) AS scenario,
             min(CASE WHEN l_suppkey % 2 = 0 THEN 'boasting' ELSE 'ambiguous' END) AS introduction, {means}
      FROM lineitem GROUP BY 1, 2)
"""


RESPONSES_SQL = _response_sql()


# ---------------------------------------------------------------- scored
N_CLASSES = 5


def _weight(k: int):
    base = (F.col("l_partkey") * (k + 3) + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 11 + 1
    y = F.col("l_quantity").cast("int") % 5
    return base + F.when((y == k) & (F.col("l_orderkey") % 3 != 0), 9).otherwise(0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification outputs: (row_id, y_true, probs ARRAY<DOUBLE>[5])."""
    li = table(spark, sf_dir, "lineitem")
    ws = [_weight(k) for k in range(N_CLASSES)]
    total = sum(ws[1:], ws[0])
    return li.select(
        F.concat_ws(
            "-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_suppkey"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("row_id"),
        (F.col("l_quantity").cast("int") % 5).cast("int").alias("y_true"),
        F.array(*[(w / total).cast("double") for w in ws]).alias("probs"),
    )


def _w_sql(k: int) -> str:
    return (f"((l_partkey * {k + 3} + l_suppkey * 7 + l_linenumber) % 11 + 1 + "
            f"CASE WHEN CAST(l_quantity AS INT) % 5 = {k} AND l_orderkey % 3 <> 0 THEN 9 ELSE 0 END)")


# Wide form for the oracle: w0..w4 integers and their total; probs are w_k / wsum.
SCORED_SQL = (
    "SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
    "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
    "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_id, "
    "CAST(l_quantity AS INT) % 5 AS y_true, "
    + ", ".join(f"{_w_sql(k)} AS w{k}" for k in range(N_CLASSES))
    + " FROM lineitem"
)
# conf = max(w)/wsum, pred = lowest k with the max weight
SCORED_WIDE_SQL = f"""
SELECT row_id, y_true, w0, w1, w2, w3, w4,
       (w0 + w1 + w2 + w3 + w4) AS wsum,
       greatest(w0, w1, w2, w3, w4) AS wmax,
       CASE WHEN w0 = greatest(w0, w1, w2, w3, w4) THEN 0
            WHEN w1 = greatest(w0, w1, w2, w3, w4) THEN 1
            WHEN w2 = greatest(w0, w1, w2, w3, w4) THEN 2
            WHEN w3 = greatest(w0, w1, w2, w3, w4) THEN 3 ELSE 4 END AS y_pred
FROM ({SCORED_SQL}) s
"""


# ---------------------------------------------------------------- straight
def straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-response cases: (row_id, participant, cell, value)."""
    ev = table(spark, sf_dir, "events")
    fv = F.floor("value").cast("bigint")
    u = F.col("user_id")
    return ev.select(
        F.col("event_id").alias("row_id"),
        u.alias("participant"),
        F.col("event_type").alias("cell"),
        F.when(u % 5 == 0, F.lit(3).cast("bigint")).when(u % 5 == 1, fv % 2 + 1).otherwise(fv % 5 + 1).alias("value"),
    )


STRAIGHT_SQL = """
SELECT event_id AS row_id, user_id AS participant, event_type AS cell,
       CASE WHEN user_id % 5 = 0 THEN 3
            WHEN user_id % 5 = 1 THEN CAST(floor(value) AS BIGINT) % 2 + 1
            ELSE CAST(floor(value) AS BIGINT) % 5 + 1 END AS value
FROM events
"""


# ---------------------------------------------------------------- repeat ids
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat-participation input: id = user_id, combination = event_type, order = event_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("participant"),
                     F.col("event_type").alias("combo"))


REPEATS_SQL = """
SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS participant, event_type AS combo FROM events
"""


# ---------------------------------------------------------------- importances / nodes
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("model"),
        F.concat(F.col("o_orderstatus"), F.lit("_"), (F.col("o_custkey") % 3).cast("string")).alias("feature"),
    ).agg(F.sum("o_totalprice").alias("importance"))


IMPORTANCES_SQL = """
SELECT o_orderpriority AS model, o_orderstatus || '_' || CAST(o_custkey % 3 AS VARCHAR) AS feature,
       sum(o_totalprice) AS importance
FROM orders GROUP BY 1, 2
"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 20).alias("tree"), F.col("o_orderpriority").alias("feature"),
                    F.col("o_totalprice").alias("gain"))


NODES_SQL = """
SELECT o_custkey % 20 AS tree, o_orderpriority AS feature, o_totalprice AS gain FROM orders
"""


# ---------------------------------------------------------------- signal
def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features for training: numeric, categorical, group, target with signal."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                                              "o_orderstatus")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    mx = o.agg(F.max("o_totalprice").alias("mx"))  # one row: broadcast is size-proven
    j = j.crossJoin(F.broadcast(mx))
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("grp"),
        "c_acctbal", "o_totalprice", "c_mktsegment", "o_orderpriority", "o_orderstatus",
        (F.lit(1.0) + 4 * F.col("o_totalprice") / F.col("mx")
         + 0.5 * (F.col("c_mktsegment") == "BUILDING").cast("double")).alias("target"),
    )


SIGNAL_SQL = """
SELECT o_orderkey AS row_id, o_custkey AS grp, c_acctbal, o_totalprice, c_mktsegment, o_orderpriority,
       o_orderstatus,
       1.0 + 4 * o_totalprice / (SELECT max(o_totalprice) FROM orders)
           + 0.5 * CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS target
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the proxy CTEs it needs (in dependency order)."""
    defs = {
        "ratings": RATINGS_SQL, "panel": PANEL_SQL, "scored": SCORED_WIDE_SQL, "straight": STRAIGHT_SQL,
        "repeats": REPEATS_SQL, "importances": IMPORTANCES_SQL, "nodes": NODES_SQL, "signal": SIGNAL_SQL,
        "responses": RESPONSES_SQL,
    }
    need = list(names)
    if "panel" in need and "ratings" not in need:
        need.insert(0, "ratings")
    order = ["ratings", "panel", "scored", "straight", "repeats", "importances", "nodes", "signal", "responses"]
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in order if n in need)
    return f"WITH {ctes}\n{sql}"
