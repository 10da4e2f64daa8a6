"""Boosted regression trees on histograms: logistic loss, weighted rows, a level of a tree per pass.

The trees are those that `GBTClassifier` grows (same thresholds, variance gains and
leaf means), by other sums: a row is a few codes, each of which stands for the bins of
several features, and its score so far. A task adds up the codes of its rows per node
and takes the features' histograms from these sums, so a pass costs a few additions per
row, and what reaches the driver is a histogram per node, whatever the number of rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.session import ensure_checkpoint_dir, remove, scratch_path

# Rows of one chunk; codes that share a number, and levels whose decisions fit a word of 64 bits.
CHUNK_ROWS = 1 << 16
CODES = 2048
WORD_LEVELS = 6
MAX_DEPTH = 12
# Rows that are worth a task of their own, and the most that one task holds.
TASK_ROWS, MOST_ROWS = 100_000, 4_000_000

Chunk = tuple[np.ndarray, np.ndarray, np.ndarray]  # codes by group, labels as -1 and 1, scores


@dataclass
class Bins:
    """Thresholds by feature, and the features whose bins share a code, each with its step in the code."""

    cuts: list[np.ndarray]
    groups: list[list[tuple[int, int]]]

    def size(self, group: int) -> int:
        return prod(len(self.cuts[f]) + 1 for f, _ in self.groups[group])

    def starts(self) -> np.ndarray:
        """Where each feature's bins begin in a histogram of all."""
        return np.cumsum([0, *(len(c) + 1 for c in self.cuts)])


@dataclass
class Tree:
    """Nodes in heap order: node n has children 2n+1 and 2n+2; a feature of -1 marks a leaf or no node."""

    feature: np.ndarray
    split: np.ndarray
    stats: np.ndarray  # per node: weight, sum and sum of squares of the target
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros((n, 3)), np.full(n, -1.0))

    def leaf_values(self, depth: int) -> np.ndarray:
        """Predictions by place in the last level; places below a leaf have the leaf's."""
        value = self.stats[:, 1] / np.where(self.stats[:, 0] > 0, self.stats[:, 0], 1.0)
        for n in range((1 << depth) - 1):
            if self.feature[n] < 0:
                value[[2 * n + 1, 2 * n + 2]] = value[n]
        return value[(1 << depth) - 1 :]


def thresholds(weights: dict[float, float], splits: int) -> np.ndarray:
    """At most `splits` cuts halfway between neighbouring values, at about equal weights."""
    values = np.array(sorted(weights))
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= splits:
        return middles
    cuts, stride = [], sum(weights.values()) / (splits + 1)
    reached, target = weights[values[0]], stride
    for at in range(1, len(values)):
        before, reached = reached, reached + weights[values[at]]
        if abs(before - target) < abs(reached - target):
            cuts.append(middles[at - 1])
            target += stride
    return np.array(cuts)


def share_codes(ranks: list[int], most: int) -> list[list[tuple[int, int]]]:
    """Features, by their number of ranks, in groups of at most `most` combinations or one feature, each with its step in the code."""
    groups: list[list[tuple[int, int]]] = []
    sizes: list[int] = []
    for f in sorted(range(len(ranks)), key=lambda f: -ranks[f]):
        at = next((g for g, size in enumerate(sizes) if size * ranks[f] <= most), len(groups))
        if at == len(groups):
            groups.append([])
            sizes.append(1)
        groups[at].append((f, sizes[at]))
        sizes[at] *= ranks[f]
    return groups


def fit_bins(rows: DataFrame, width: int, n: int, positive: float, bins: int, seed: int) -> Bins:
    """Thresholds from some 10,000 rows, or all if there are fewer, as `GBTClassifier` takes them."""
    most = min(bins, n)
    share = max(most * most, 10_000) / n
    some = rows if share >= 1 else rows.sample(False, share, seed)
    weight = F.when(F.col("label") == 1, F.lit(positive)).otherwise(F.lit(1.0))
    pairs = some.select(F.posexplode("features").alias("feature", "value"), weight.alias("weight"))
    known: list[dict[float, float]] = [{} for _ in range(width)]
    for r in pairs.groupBy("feature", "value").agg(F.sum("weight").alias("weight")).collect():
        known[r.feature][r.value] = r.weight
    cuts = [thresholds(w, most - 1) for w in known]
    return Bins(cuts, share_codes([len(c) + 1 for c in cuts], CODES))


def chunk_rows(bins: Bins, width: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of features and labels as chunks of codes and of labels."""

    def chunk(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codes, labels = (np.concatenate(a, axis=-1) for a in zip(*held))
        return pa.RecordBatch.from_pydict({
            "codes": pa.array([codes.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary())
        })

    held, count = [], 0
    for batch in batches:
        x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        binned = [np.searchsorted(cut, x[:, f]) for f, cut in enumerate(bins.cuts)]
        codes = np.array([sum(binned[f] * step for f, step in group) for group in bins.groups], dtype=np.uint16)
        label = batch.column("label").to_numpy(zero_copy_only=False)
        held.append((codes, np.where(label == 1, 1, -1).astype(np.int8)))
        count += len(label)
        if count >= CHUNK_ROWS:
            yield chunk(held)
            held, count = [], 0
    if count:
        yield chunk(held)


def decisions(bins: Bins, tree: Tree, levels: int) -> list[tuple[int, list[np.ndarray | None]]]:
    """For runs of levels, by group: per code a word of which nodes of the run send it right; None if no node asks the group."""
    runs = []
    for done in range(0, levels, WORD_LEVELS):
        below = min(WORD_LEVELS, levels - done)
        tables: list[np.ndarray | None] = []
        for g, group in enumerate(bins.groups):
            size = bins.size(g)
            table = np.zeros((1 << done, size), dtype=np.int64)
            number = np.arange(size)
            for f, step in group:
                which = number // step % (len(bins.cuts[f]) + 1)
                for top in range(1 << done):
                    for inner in range((1 << below) - 1):
                        level = (inner + 1).bit_length() - 1
                        at = (((1 << done) + top) << level) + inner - (1 << level)
                        if tree.feature[at] == f:
                            table[top] |= (which > tree.split[at]).astype(np.int64) << inner
            tables.append(table if table.any() else None)
        runs.append((below, tables))
    return runs


def walk(codes: np.ndarray, runs: list[tuple[int, list[np.ndarray | None]]]) -> np.ndarray:
    """Each row's place in the level below all runs."""
    place = np.zeros(codes.shape[1], dtype=np.int64)
    for nth, (below, tables) in enumerate(runs):
        words = np.zeros(codes.shape[1], dtype=np.int64)
        for g, table in enumerate(tables):
            if table is not None:
                words |= np.take(table, place * table.shape[1] + codes[g] if nth else codes[g])
        node = np.zeros(codes.shape[1], dtype=np.int64)
        for _ in range(below):
            right = words >> node
            right &= 1
            node += node
            node += right
            node += 1
        place = (place << below) + node - ((1 << below) - 1)
    return place


def target(chunk: Chunk, first: bool) -> np.ndarray:
    """What a tree is fitted to: the labels, then the loss's falling gradient."""
    _, sign, score = chunk
    if first:
        return sign.astype(float)
    odds = np.multiply(sign, 2.0)
    odds *= score
    np.exp(odds, out=odds)
    odds += 1.0
    return np.divide(np.multiply(sign, 4.0), odds, out=odds)


def level_sums(chunks: Iterable[Chunk], bins: Bins, tree: Tree, level: int, positive: float, first: bool) -> Iterator[np.ndarray]:
    """Weight, sum and sum of squares of the target: three by the level's nodes by the bins of all features."""
    nodes, starts = 1 << level, bins.starts()
    sums = [np.zeros((3, nodes, bins.size(g))) for g in range(len(bins.groups))]
    runs = decisions(bins, tree, level)
    for chunk in chunks:
        codes, sign, _ = chunk
        y = target(chunk, first)
        weight = np.where(sign > 0, positive, 1.0)
        wy = weight * y
        measures = (weight, wy, wy * y)
        place = walk(codes, runs)
        for g, total in enumerate(sums):
            size = total.shape[2]
            index = place * size
            index += codes[g]
            for i, m in enumerate(measures):
                total[i] += np.bincount(index, m, nodes * size).reshape(nodes, size)
    out = np.zeros((3, nodes, starts[-1]))
    for group, total in zip(bins.groups, sums):
        # The first feature has the smallest step, so it is the last axis.
        grid = total.reshape(3, nodes, *[len(bins.cuts[f]) + 1 for f, _ in reversed(group)])
        for i, (f, _) in enumerate(group):
            axes = tuple(a for a in range(2, grid.ndim) if a != grid.ndim - 1 - i)
            out[:, :, starts[f] : starts[f + 1]] = grid.sum(axis=axes)
    yield out


def add_tree(chunks: Iterable[Chunk], bins: Bins, tree: Tree, depth: int, rate: float) -> Iterator[Chunk]:
    runs, added = decisions(bins, tree, depth), rate * tree.leaf_values(depth)
    for codes, sign, score in chunks:
        yield codes, sign, score + np.take(added, walk(codes, runs))


def variance(stats: np.ndarray) -> np.ndarray:
    """Of weight, sum and sum of squares along the first axis; zero without weight."""
    weight = np.where(stats[0] > 0, stats[0], 1.0)
    return np.where(stats[0] > 0, (stats[2] - stats[1] * stats[1] / weight) / weight, 0.0)


def split_level(tree: Tree, sums: np.ndarray, bins: Bins, level: int) -> bool:
    """Give each open node of the level its best split; whether any was split."""
    starts, split = bins.starts(), False
    for place in range(1 << level):
        at = (1 << level) - 1 + place
        if level == 0:
            tree.stats[0] = sums[:, 0, : starts[1]].sum(axis=1)
        elif tree.feature[(at - 1) // 2] < 0:
            continue
        whole, impurity = tree.stats[at], variance(tree.stats[at])
        if level and abs(impurity) < np.finfo(float).eps:
            continue
        best = (0.0, -1, 0, whole, whole)
        for f, cut in enumerate(bins.cuts):
            left = np.cumsum(sums[:, place, starts[f] : starts[f + 1]], axis=1)
            total, left = left[:, -1:], left[:, :-1]
            if not len(cut):
                continue
            right = total - left
            gain = impurity - left[0] / total[0] * variance(left) - right[0] / total[0] * variance(right)
            # Weights are sums, so an empty side can be off zero by rounding.
            tiny = total[0] * 1e-12
            gain = np.where((left[0] > tiny) & (right[0] > tiny), gain, -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i, left[:, i], right[:, i])
        if best[1] >= 0:
            tree.gain[at], tree.feature[at], tree.split[at], tree.stats[2 * at + 1], tree.stats[2 * at + 2] = best
            split = True
    return split


def grow_trees(spark: SparkSession, state: RDD, bins: Bins, trees: int, depth: int, rate: float, positive: float) -> list[Tree]:
    """A tree after the other, a level in a pass; the scores are kept and cut from their lineage every ten trees."""
    grown: list[Tree] = []
    saved: str | None = None
    state = state.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    for number in range(trees):
        before, first = None, number == 0
        if grown:
            last, share = grown[-1], 1.0 if number == 1 else rate
            before, state = state, state.mapPartitions(lambda chunks, t=last, r=share: add_tree(chunks, bins, t, depth, r))
            state = state.persist(StorageLevel.MEMORY_AND_DISK_DESER)
            if number % 10 == 0:
                state.checkpoint()
        tree = Tree.empty(depth)
        for level in range(depth):
            part = lambda chunks, t=tree, l=level: level_sums(chunks, bins, t, l, positive, first)
            more = split_level(tree, state.mapPartitions(part).reduce(np.add), bins, level)
            if before:
                before.unpersist()
                before = None
                if state.isCheckpointed():
                    if saved:
                        remove(spark, saved)
                    saved = state.getCheckpointFile()
            if not more:
                break
        grown.append(tree)
    state.unpersist()
    if saved:
        remove(spark, saved)
    return grown


def tree_nodes(tree: Tree, bins: Bins) -> list[tuple]:
    """The nodes in order, each subtree after its parent, as Spark stores them; equal sister leaves are one."""
    impurity = variance(tree.stats.T)

    def under(at: int) -> tuple:
        weight, total, _ = tree.stats[at]
        own = (float(total / weight) if weight > 0 else 0.0, float(impurity[at]), tree.stats[at].tolist())
        if at >= len(tree.feature) // 2 or tree.feature[at] < 0:
            return own, None, None
        left, right = under(2 * at + 1), under(2 * at + 2)
        if left[1] is None and right[1] is None and left[0][0] == right[0][0]:
            return own, None, None
        f = int(tree.feature[at])
        return own, (float(tree.gain[at]), f, float(bins.cuts[f][tree.split[at]])), (left, right)

    out: list[tuple] = []

    def write(node: tuple) -> int:
        (prediction, spread, stats), cut, children = node
        number = len(out)
        out.append(())
        ends = (-1, -1) if cut is None else (write(children[0]), write(children[1]))
        gain, split = (-1.0, (-1, [], -1)) if cut is None else (cut[0], (cut[1], [cut[2]], -1))
        out[number] = (number, prediction, spread, stats, -1, gain, *ends, split)
        return number

    write(under(0))
    return out


NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def as_spark_model(spark: SparkSession, learner: GBTClassifier, grown: list[Tree], bins: Bins, rate: float) -> GBTClassificationModel:
    """The trees as a model of Spark, by way of its saved form."""

    def about(kind: str, uid: str, set_: dict, default: dict, **more: int) -> str:
        known = {"class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
        return json.dumps({**known, "paramMap": set_, "defaultParamMap": default, **more})

    path = scratch_path(spark, "boosted")
    set_ = {p.name: learner.getOrDefault(p) for p in learner.params if learner.isSet(p)}
    default = {p.name: learner.getOrDefault(p) for p in learner.params if learner.hasDefault(p) and not learner.isSet(p)}
    kind = "org.apache.spark.ml.classification.GBTClassificationModel"
    whole = about(kind, learner.uid, set_, default, numFeatures=len(bins.cuts), numTrees=len(grown))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    of_tree = "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
    shared = {k: v for k, v in set_.items() if k in ("featuresCol", "labelCol", "weightCol", "maxBins", "maxDepth", "seed")}
    weights = [(i, about(of_tree, f"dtr_{uuid.uuid4().hex[:12]}", shared, {}), 1.0 if i == 0 else rate) for i in range(len(grown))]
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [(i, n) for i, tree in enumerate(grown) for n in tree_nodes(tree, bins)]
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/data")
    model = GBTClassificationModel.load(path)
    remove(spark, path)
    return model


def fit_boosted(rows: DataFrame, learner: GBTClassifier, positive: float) -> GBTClassificationModel:
    """Fit `learner` to rows with its features and a label of 0 or 1; label 1 weighs `positive`, label 0 one."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    depth, trees, rate = learner.getMaxDepth(), learner.getMaxIter(), learner.getStepSize()
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"trees have 1 to {MAX_DEPTH} levels")
    plain = rows.select(vector_to_array(learner.getFeaturesCol()).alias("features"), F.col(learner.getLabelCol()).alias("label"))
    size = plain.agg(F.count("*").alias("n"), F.count_if(F.col("label").isin(0, 1)).alias("good"), F.max(F.size("features")).alias("width")).first()
    if not size.n or size.n != size.good:
        raise ValueError("training needs rows, and each a label of 0 or 1")
    bins = fit_bins(plain, size.width, size.n, positive, learner.getMaxBins(), learner.getSeed())
    cores = spark.sparkContext.defaultParallelism
    tasks = min(cores, ceil(size.n / TASK_ROWS)) * ceil(size.n / (cores * MOST_ROWS))
    chunks = plain.repartition(tasks).mapInArrow(lambda batches: chunk_rows(bins, size.width, batches), "codes binary, labels binary")

    def read(r) -> Chunk:
        labels = np.frombuffer(r.labels, dtype=np.int8)
        return np.frombuffer(r.codes, dtype=np.uint16).reshape(-1, len(labels)), labels, np.zeros(len(labels))

    grown = grow_trees(spark, chunks.rdd.map(read), bins, trees, depth, rate, positive)
    return as_spark_model(spark, learner, grown, bins, rate)
