"""Networks trained side by side against those of Spark ML, and where their rows are."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from faultsift.operators import models, networks
from faultsift.session import stage

LAYERS = (2, 5, 2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [([rng.gauss(0, 1), rng.gauss(0, 1)], float(rng.random() < 0.4), float(rng.choice([1, 1, 4])), i % 3) for i in range(90)]
    return stage(spark.createDataFrame(data, "features array<double>, label double, weight double, fold int").coalesce(1))


@pytest.mark.parametrize("iterations", [0, 1, 3, 12])
def test_steps_are_those_of_spark(rows, iterations):
    """Weights stand for copies; the network of fold 1 does not see its rows. 128 rows or fewer are one block of Spark."""
    copies = rows.where("fold <> 1").limit(40).coalesce(1)
    opened = copies.select("features", "label", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).coalesce(1)
    assert opened.count() <= 128
    vectors = opened.select(array_to_vector("features").alias("features"), "label")
    make = lambda n: MultilayerPerceptronClassifier(layers=list(LAYERS), seed=7, maxIter=n, tol=1e-6).fit(vectors).weights.toArray()
    kept = stage(copies.unionByName(rows.where("fold = 1")))
    scale = (np.zeros(2), np.ones(2))
    found = networks.trained(kept, {1: scale}, LAYERS, make(0), iterations, 1e-6)
    assert np.allclose(found[1], make(iterations), atol=1e-7)


def test_gradient_against_differences(rows):
    x = np.array([r.features for r in rows.collect()])
    labels, weights = np.arange(90) % 2, np.linspace(0.5, 2.0, 90)
    point = np.random.default_rng(1).normal(size=2 * 5 + 5 + 5 * 2 + 2)
    _, gradient = networks.loss_and_gradient(point, x, labels, weights, LAYERS)
    for i, unit in enumerate(np.eye(len(point)) * 1e-6):
        up, down = (networks.loss_and_gradient(point + u, x, labels, weights, LAYERS)[0] for u in (unit, -unit))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-4


def test_folds_share_their_passes(spark, rows):
    """Rows of one file are dealt to all cores, and a pass serves the networks of all folds."""
    samples = stage(rows.select(F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"), F.col("label").alias("match"), "fold").coalesce(1))
    spark.sparkContext.setJobGroup("train", "train")
    found = models.fold_models(samples, 3, columns=["f1", "f2"], hidden=3, iterations=5)
    tracker = spark.sparkContext.statusTracker()
    sizes = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("train") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 3 and sum(s is not None and s.numTasks == spark.sparkContext.defaultParallelism for s in sizes) >= 5


def test_labels_are_checked(spark):
    for bad in (None, 2):
        samples = spark.createDataFrame([(0.0, 0), (1.0, 1), (2.0, bad)], "f1 double, match int")
        with pytest.raises(Exception):
            models.train_scorer(samples, ["f1"], hidden=2, iterations=2)
