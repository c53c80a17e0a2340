"""Degenerate groups, clashing names, shared prefixes: defined results."""

import math
import time

import pytest
from pyspark.sql import functions as F

from panelkit.functions import tails
from panelkit.functions.basis import FORMS
from panelkit.operators import clean, equations, metrics, nonparam, ranks, split


def test_zero_mad_group_keeps_its_rows(spark):
    df = spark.createDataFrame([("a", 3.0)] * 5 + [("a", 9.0)] + [("b", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    got = clean.remove_group_outliers(df, "g", "v")
    assert sorted(r["v"] for r in got.where("g = 'a'").collect()) == [3.0] * 5 + [9.0]
    assert sorted(r["v"] for r in got.where("g = 'b'").collect()) == [1, 2, 3, 4]


def test_zscore_without_spread_is_null(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["v_z"] for r in clean.zscore(df, "v", by=["g"]).collect()}
    assert got["a", 2.0] is None and got["b", 3.0] == pytest.approx(1 / math.sqrt(2))


def test_r2_of_a_constant_target(spark):
    df = spark.createDataFrame([("hit", 2.0, 2.0), ("hit", 2.0, 2.0), ("miss", 2.0, 3.0)], "g string, y double, p double")
    got = {r["g"]: r["r2"] for r in metrics.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert got == {"hit": 1.0, "miss": 0.0}


def test_mode_mae(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 5.0)], "y double, m double")
    assert metrics.mode_mae(df, "y", "m").first()["mae"] == 0.5


def test_dunn_with_all_values_tied(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, y double")
    h, pairs = nonparam.kruskal_dunn(df, "y", "g")
    assert h.first()["H"] is None and h.first()["p"] is None
    r = pairs.first()
    assert r["z"] is None and r["p"] is None and r["p_holm"] is None


def test_brown_forsythe_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, y double")
    r = nonparam.brown_forsythe(df, "y", "g").first()
    assert r["F"] is None and r["p"] is None
    one = nonparam.brown_forsythe(df.where("g = 'a'"), "y", "g").first()
    assert one["F"] is None


def _slow_ncf(f, d1, d2, ncp):
    x, half = d1 * f / (d1 * f + d2), ncp / 2
    return sum(math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) * tails.betainc(d1 / 2 + j, d2 / 2, x)
               for j in range(int(half + 12 * math.sqrt(half) + 60)))


def test_noncentral_f_matches_the_plain_sum():
    for f, d1, d2, ncp in ((6.86, 19, 2147, 100), (1.2, 3, 40, 2.5), (0.4, 1, 10, 0.3), (25, 4, 300, 90), (300, 19, 1748, 5000)):
        assert tails.ncf_cdf(f, d1, d2, ncp) == pytest.approx(_slow_ncf(f, d1, d2, ncp), abs=1e-10)


def test_partial_eta_interval_is_fast_and_brackets():
    t = time.time()
    lo, hi = tails.eta2_partial_ci(3000, 19, 18848)
    assert time.time() - t < 0.5
    point = 19 * 3000 / (19 * 3000 + 18848)
    assert lo < point < hi and hi - lo < 0.02
    assert tails.eta2_partial_ci(0.5, 2, 30)[0] == 0.0


def test_string_keys_with_a_shared_prefix_use_many_buckets(spark):
    df = spark.range(20_000).select(F.format_string("user_%015d", "id").alias("k"))
    cuts = ranks._cut_points(df, "k", 64, False)
    assert len(cuts) > 50
    sizes = ranks._with_bucket(df, "k", cuts).groupBy("__b").count().agg(F.max("count")).first()[0]
    assert sizes < 20_000 / 10
    got = ranks.row_number(df, ["k"]).where("row_number <> cast(substr(k, 6) as bigint) + 1").count()
    assert got == 0


def test_thousands_of_buckets_plan_in_seconds(spark):
    df = spark.range(20_000).select(F.xxhash64("id").cast("double").alias("v"))
    t = time.time()
    got = ranks.average_rank(df, "v", buckets=4000)
    assert got.agg(F.sum("rank")).first()[0] == 20_000 * 20_001 / 2
    assert time.time() - t < 25


def test_binary_search_counts_cuts_below(spark):
    cuts = [1.0, 2.0, 2.5, 7.0, 9.0]
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.5, 2.6, 7.0, 8.0, 9.0, 99.0)], "v double")
    got = {r["v"]: r["__b"] for r in ranks._with_bucket(df, "v", cuts).collect()}
    assert got == {v: sum(c < v for c in cuts) for v in got}


def test_poisson_weights_have_no_cap():
    cdf = split.poisson1_cdf()
    assert len(cdf) == 20 and 1 - cdf[-1] < 2 ** -50


def test_draws_of_a_large_stratum_come_in_blocks(spark, monkeypatch):
    df = spark.range(2500).select(F.format_string("p%05d", "id").alias("k"), F.lit("s").alias("g"))
    want = sorted((r["k"], r["b"]) for r in split.bootstrap_draws(df, "k", ["g"], 2).collect())
    monkeypatch.setattr(split, "DRAW_BLOCK", 100)
    assert sorted((r["k"], r["b"]) for r in split.bootstrap_draws(df, "k", ["g"], 2).collect()) == want
    assert len(want) == 5000


def _grid(spark, key="k"):
    rows = [(g, float(x1), float(x2), float(3 * x1 + 1 if g == "p" else 5 * x2 - 2))
            for g in "pq" for x1, x2 in ((1, 7), (2, 3), (3, 11), (4, 2), (5, 13), (6, 5))]
    return spark.createDataFrame(rows, f"{key} string, x1 double, x2 double, y double")


@pytest.mark.parametrize("key", ["k", "sf", "sy", "cf", "__x0x"])
def test_any_key_name_fits(spark, key):
    fits = equations.fit_equations(_grid(spark, key), [key], ["x1", "x2"], "y", FORMS)
    best = {r[key]: r["loss"] for r in fits.groupBy(key).agg(F.min("loss").alias("loss")).collect()}
    assert max(best.values()) < 1e-9
    two = equations.fit_two_term(_grid(spark, key), [key], ["x1", "x2"], "y", FORMS)
    assert key in two.columns and two.count() > 0


def test_key_named_like_a_result_column_is_refused(spark):
    with pytest.raises(ValueError):
        equations.fit_equations(_grid(spark, "loss"), ["loss"], "x1", "y")


def test_prediction_and_text_use_the_chosen_predictor(spark):
    df = _grid(spark)
    hof = equations.hall_of_fame(equations.fit_equations(df, ["k"], ["x1", "x2"], "y"), ["k"])
    best = hof.where("loss < 1e-9").where("form = 'x' and variant = 'affine'").withColumn("chosen", F.lit(True))
    pred = equations.predict(df, best, ["k"], ["x1", "x2"])
    assert pred.columns == [*df.columns, "prediction"]
    assert all(r["prediction"] == pytest.approx(r["y"]) for r in pred.collect())
    text = {r["k"]: r["equation"] for r in equations.equation_text(best).collect()}
    assert "x1" in text["p"] and "x2" in text["q"]
    with pytest.raises(Exception, match="outside"):
        equations.predict(df, best, ["k"], "x1").collect()


def test_two_term_prediction_and_text(spark):
    rows = [("g", float(a), float(b), 2.0 * a + 3.0 * b * b - 1) for a, b in ((1, 4), (2, 1), (3, 5), (4, 2), (5, 9), (6, 3), (7, 8))]
    df = spark.createDataFrame(rows, "k string, u double, w double, y double")
    two = equations.fit_two_term(df, ["k"], ["u", "w"], "y").orderBy("loss").limit(1).withColumn("chosen", F.lit(True))
    assert two.first()["loss"] < 1e-6
    for r in equations.predict(df, two, ["k"], ["u", "w"]).collect():
        assert r["prediction"] == pytest.approx(r["y"], abs=1e-3)
    text = equations.equation_text(two).first()["equation"]
    assert "u" in text and "square(w)" in text


def test_a_caller_defined_form_is_fitted_predicted_and_printed(spark):
    from panelkit.functions import basis

    forms = basis.extend("third_root", 3, lambda x: F.cbrt(x))
    df = spark.createDataFrame([("g", float(v), 4.0 * float(v) ** (1 / 3) + 2) for v in (1, 8, 20, 27, 64, 100)],
                               "k string, x double, y double")
    hof = equations.hall_of_fame(equations.fit_equations(df, ["k"], "x", "y", forms), ["k"])
    best = hof.orderBy("loss").limit(1).withColumn("chosen", F.lit(True))
    assert best.first()["form"] == "third_root" and best.first()["loss"] < 1e-9
    assert all(abs(r["prediction"] - r["y"]) < 1e-6 for r in equations.predict(df, best, ["k"], "x", forms=forms).collect())
    assert "third_root(x)" in equations.equation_text(best, forms=forms).first()["equation"]
