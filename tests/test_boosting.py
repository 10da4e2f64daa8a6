"""Boosted trees on histograms."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallywing.operators import boosting as B


def labelled(spark, n):
    """Rows whose label depends on four of five features; positives weigh 2.5."""
    number = lambda seed, most: F.pmod(F.hash("id", F.lit(seed)), F.lit(most)).cast("double")
    rows = spark.range(n).select("id", number(1, 1000).alias("a"), number(2, 5).alias("b"), number(3, 24).alias("c"),
                                 number(4, 2).alias("d"), F.lit(1.0).alias("e"), number(5, 100).alias("noise"))
    rows = rows.withColumn("label", (F.col("noise") < 10 + F.col("a") / 20 + F.col("b") * 5 - F.col("c") + F.col("d")).cast("double"))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 2.5).otherwise(1.0))
    return VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(rows).repartition(3)


def learner(trees, depth):
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", lossType="logistic",
                         maxIter=trees, maxDepth=depth, stepSize=0.1, maxBins=64, seed=42)


@pytest.mark.parametrize("n,trees,depth,codes", [(2000, 12, 4, 2048), (1500, 3, 8, 16), (40, 2, 3, 2048)])
def test_trees_are_those_of_spark(spark, monkeypatch, n, trees, depth, codes):
    """With several tasks, chunks and groups, a checkpoint, and levels beyond one word of decisions."""
    monkeypatch.setattr(B, "TASK_ROWS", 600)
    monkeypatch.setattr(B, "CODES", codes)
    rows = labelled(spark, n).cache()
    want, got = learner(trees, depth).fit(rows), B.fit_boosted(rows, learner(trees, depth), 2.5)
    scored = [m.transform(rows).select("id", vector_to_array("probability")[1].alias(name)) for m, name in ((want, "p"), (got, "q"))]
    assert scored[0].join(scored[1], "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    assert got.getNumTrees == trees and got.numFeatures == 5 and got.treeWeights == want.treeWeights
    assert got.getMaxDepth() == depth and got.getStepSize() == 0.1
    assert np.isclose(want.featureImportances.toArray(), got.featureImportances.toArray(), atol=0.01).all()


def test_what_a_pass_sends_does_not_grow_with_the_rows():
    bins = B.Bins([np.arange(9) + 0.5, np.arange(3) + 0.5, np.array([])], [[(0, 1), (1, 10)], [(2, 1)]])
    tree = B.Tree.empty(3)
    rng, found = np.random.default_rng(3), []
    for chunks in (1, 5):
        x = [[rng.integers(0, 10, 700), rng.integers(0, 4, 700)] for _ in range(chunks)]
        rows = [(np.array([a + 10 * b, 0 * a], dtype=np.uint16), np.where(a > 4, 1, -1).astype(np.int8), np.zeros(700)) for a, b in x]
        (sums,) = B.level_sums(rows, bins, tree, 0, 2.0, True)
        found.append(sums)
        a, b = (np.concatenate(c) for c in zip(*x))
        weight = np.where(a > 4, 2.0, 1.0)
        assert np.allclose(sums[0, 0, :10], np.bincount(a, weight, 10)) and np.allclose(sums[0, 0, 10:14], np.bincount(b, weight, 4))
        assert np.allclose(sums[1, 0, :10], np.bincount(a, weight * np.where(a > 4, 1, -1), 10))
    assert found[0].shape == found[1].shape == (3, 1, 15)


def test_one_label_gives_one_score(spark):
    rows = labelled(spark, 30).withColumn("label", F.lit(0.0))
    model = B.fit_boosted(rows, learner(2, 3), 1.0)
    p = vector_to_array("probability")[1]
    low, high = model.transform(rows).agg(F.min(p), F.max(p)).first()
    assert high < 0.5 and high - low < 1e-9


def test_rows_without_a_label_are_refused(spark):
    rows = labelled(spark, 30)
    for bad in (rows.limit(0), rows.withColumn("label", F.when(F.col("id") != 3, F.col("label")))):
        with pytest.raises(ValueError):
            B.fit_boosted(bad, learner(2, 3), 1.0)


def test_decisions_are_made_once_for_all_chunks_of_a_task(monkeypatch):
    """Their cost does not grow with the rows."""
    bins = B.Bins([np.arange(9) + 0.5, np.arange(3) + 0.5], [[(0, 1), (1, 10)]])
    tree, calls, made = B.Tree.empty(2), [], B.decisions
    tree.feature[:3], tree.split[:3] = [0, 1, 0], [4, 1, 7]
    monkeypatch.setattr(B, "decisions", lambda *a: calls.append(a) or made(*a))
    rng = np.random.default_rng(4)
    chunks = [(rng.integers(0, 40, (1, 50)).astype(np.uint16), np.ones(50, np.int8), np.zeros(50)) for _ in range(3)]
    list(B.level_sums(chunks, bins, tree, 1, 2.0, True))
    tree.stats[:, 0], tree.stats[:, 1] = 1.0, np.arange(7)
    moved = list(B.add_tree(chunks, bins, tree, 2, 0.5))
    assert len(calls) == 2
    for (codes, _, _), (_, _, score) in zip(chunks, moved):
        a, b = codes[0] % 10, codes[0] // 10
        assert (score == 0.5 * np.where(a > 4, np.where(a > 7, 6, 5), np.where(b > 1, 4, 3))).all()
