"""Steps whose cost must not grow faster than the rows."""

import pytest
from pyspark.sql import functions as F

from panelkit.operators import clean, explain, nonparam, ranks, split
from panelkit.sources import fixtures as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def panel(spark):
    ids = spark.range(200).select(F.col("id").alias("s"), (F.col("id") % 2).alias("a"), (F.floor(F.col("id") / 2) % 2).alias("b"))
    y = F.pmod(F.hash("s", "c"), F.lit(5)).cast("double")
    return ids.crossJoin(spark.range(3).withColumnRenamed("id", "c")).withColumn("y", y).withColumn("z", 4 - F.col("y"))


def test_art_ranks_counted_answers(spark, panel, monkeypatch):
    sizes, rank = [], ranks.average_rank

    def counted(df, *args, **kw):
        sizes.append(df.count())
        return rank(df, *args, **kw)

    monkeypatch.setattr(ranks, "average_rank", counted)
    few = nonparam.art_anova(panel, ["y", "z"], ["a", "b"], ["c"], "s").orderBy("dv", "effect").toPandas()
    assert sizes and max(sizes) <= 12 * 5 * 7 * 2  # cells x answers x effects x responses, of 8,400 copies of rows
    monkeypatch.setattr(nonparam, "LOOKUP_ROWS", 0)  # the same by a join of the rows
    many = nonparam.art_anova(panel, ["y", "z"], ["a", "b"], ["c"], "s").orderBy("dv", "effect").toPandas()
    for c in ("F", "ss_effect", "ss_error"):
        assert few[c].tolist() == pytest.approx(many[c].tolist(), rel=1e-9)


def test_weighted_average_rank_is_that_of_the_copies(spark):
    df = spark.createDataFrame([("g", 1.0, 2), ("g", 3.0, 1), ("g", 2.0, 3), ("h", 5.0, 4)], "g string, v double, n long")
    got = {(r["g"], r["v"]): r["r"] for r in ranks.average_rank(df, "v", "r", ["g"], weight="n").collect()}
    copies = df.select("g", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    assert got == {(r["g"], r["v"]): r["r"] for r in ranks.average_rank(copies, "v", "r", ["g"]).collect()}


def test_responses_shuffle_rows_not_partial_averages(spark, tmp_path):
    rows = [(o, o * 7 % 11, o % 4, o % 3, float(o % 50)) for o in range(60)] + [(1, 2, None, 1, 3.0), (1, None, 2, 1, 3.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    df = fx.responses(spark, str(tmp_path))
    assert "hashpartitioning(supp" in _plan(df) and _plan(df).count("Exchange") == 1 and "REPARTITION" in _plan(df)
    assert df.count() == len({(r[2], r[4] % 20) for r in rows})


def test_outliers_of_few_groups_sort_no_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("a", 500.0), ("b", 1.0), ("b", 1.0), (None, 2.0)], "g string, v double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = clean.remove_group_outliers(df, "g", "v")
        assert "SortMergeJoin" not in _plan(out) and out.count() == 23
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bootstrap_weights_hash_a_draw_once(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    out = split.bootstrap_weights(df, "k", 4, seed=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert out.columns == ["k", "b", "w"] and out.where("w < 1").isEmpty()


def test_permuted_copies_are_not_sorted(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    out = explain.permutation_importance(lambda d: d.withColumn("prediction", F.col("a")), df, "id", "y", ["a"], 3)
    assert "SortMergeJoin" not in _plan(out) and out.count() == 1
