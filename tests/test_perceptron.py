"""Perceptrons trained on packed rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelkit.operators import models, perceptron

COLS = ["a", "b", "c"]


@pytest.fixture
def rows(spark):
    """Blocks of whole 128 rows in one partition: MLlib then weighs all rows alike."""
    d = spark.range(1280, numPartitions=1).select("id", (F.pmod(F.hash("id"), F.lit(1000)) / 500 - 1).alias("a"),
                                                  (F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 500 - 1).alias("b"), (F.col("id") % 2).cast("double").alias("c"))
    d = d.withColumn("label", F.when(F.col("a") + F.col("b") > 0.8, 2.0).when(F.col("a") * F.col("c") < -0.1, 1.0).otherwise(0.0))
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(d).cache()


def test_packed_run_is_the_run_of_all_rows(spark, rows, monkeypatch):
    part = rows.where("id % 3 = 0").withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label")))
    part = part.withColumn("label", F.when(F.col("id") % 33 == 0, F.lit(7.0)).otherwise(F.col("label")))  # null and unknown classes
    args = (rows, {"train": rows, "part": part}, 3, 3, (6, 4), 30, 10)
    plain, fitted = models.mlp_run(*args)
    monkeypatch.setattr(models, "PLAIN_ROWS", 100)
    monkeypatch.setattr(perceptron, "PACK_ROWS", 300)
    got, packed = models.mlp_run(*args)
    assert [x[:3] for x in got] == [x[:3] for x in plain] and len(got) == 31 + 3 * 4
    assert [x[3] for x in got] == pytest.approx([x[3] for x in plain], rel=1e-6)
    for step in (10, 20, 30):
        assert packed[step].weights.toArray() == pytest.approx(fitted[step].weights.toArray(), rel=1e-3, abs=1e-4)
    same = packed[30].transform(part).join(fitted[30].transform(part).select("id", F.col("prediction").alias("p")), "id")
    assert same.where("prediction != p").isEmpty()


def test_large_tables_are_not_fitted_by_mllib(rows, monkeypatch):
    monkeypatch.setattr(models, "PLAIN_ROWS", 100)
    sizes, fit = [], models.MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(models.MultilayerPerceptronClassifier, "_fit", lambda self, d: sizes.append((d.count(), self.getMaxIter())) or fit(self, d))
    models.mlp_run(rows, {"train": rows}, 3, 3, (4,), 20, 10)
    assert sizes == [(1, 0)] * 3


def test_rows_that_mllib_refuses_stay_its_errors(rows, monkeypatch):
    monkeypatch.setattr(models, "PLAIN_ROWS", 100)
    for bad in (F.lit(None).cast("double"), F.lit(0.5)):
        with pytest.raises(PySparkException):
            d = rows.withColumn("label", F.when(F.col("id") == 7, bad).otherwise(F.col("label")))
            models.mlp_run(d, {}, 3, 3, (4,), 10, 10)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    sizes, x, y = [3, 5, 4, 3], rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    w = rng.normal(size=sum(i * o + o for i, o in zip(sizes, sizes[1:])))

    def loss(w, grad=None):
        net = perceptron._layers(w, sizes)
        return perceptron._rows_of(np.c_[x, np.ones(40)].T, y, [-w for w in net[:-1]] + net[-1:], perceptron._layers(np.zeros(len(w)) if grad is None else grad, sizes), np.zeros((4, 3), int))

    grad, eye = np.zeros(len(w)), np.eye(len(w)) * 1e-6
    loss(w, grad)
    assert grad == pytest.approx([(loss(w + e) - loss(w - e)) / 2e-6 for e in eye], abs=1e-5)


def test_lbfgs_survives_failed_searches():
    f = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3))
    x, history, _ = perceptron.lbfgs(f, np.zeros(4), 20)
    assert x == pytest.approx([3.0] * 4) and history[0] == 36 and len(history) < 20
    x, history, _ = perceptron.lbfgs(lambda x: (float(x @ x), -2 * x), np.ones(2), 5)  # wrong slopes: once again, then the end
    assert history == [2.0, 2.0] and x.tolist() == [1.0, 1.0]
