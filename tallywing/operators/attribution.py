"""Per-row, per-feature contributions of boosted trees (path-dependent Shapley values).

The contribution of a feature is its Shapley value in the game where an unknown
feature follows both branches in proportion to the training weight (Lundberg et
al. 2020). For one leaf it depends only on which of the features on the leaf's
path a row satisfies, at most 2^depth cases.

A feature has few thresholds in all trees together, so a value counts only by its
rank among them, and a leaf meets a set of ranks, kept as bits. Neighbouring leaves
ask much the same of a row: they share one table, whose rows are the combinations of
the classes of ranks that none of the leaves tells apart. The ranks of several features
make one code. A row of data needs a look-up per code, their sum and one row of the
table for all these leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.operators.boosting import share_codes
from tallywing.operators.fraud_model import FraudModel
from tallywing.operators.ranking import hash_sample
from tallywing.session import remove, scratch_path

# Largest model whose nodes are read and whose tables are sent to every executor.
MAX_NODES = 200_000
MAX_TABLE_BYTES = 512 * 1024 * 1024
# Rows of a table that leaves share; a table of this size stays in a core's cache.
TABLE_ROWS = 512
# Combinations of ranks that share a code, but for a feature that has more ranks alone.
CODES = 2048
# Rows of data that go through all tables together.
BLOCK_ROWS = 4096


@dataclass
class Leaf:
    value: float
    path: dict[int, tuple[int, float]]  # by feature: the ranks that lead here, as bits, and their part of the weight


@dataclass
class Table:
    codes: list[tuple[int, np.ndarray]]  # groups with what each code adds to the number of the table's row
    rows: np.ndarray  # contributions of all features


@dataclass
class Tables:
    cuts: list[np.ndarray]  # thresholds of every feature, in order
    groups: list[list[tuple[int, int]]]  # features whose ranks share a code, each with its step in the code
    tables: list[Table]


def read_nodes(spark: SparkSession, model: FraudModel) -> pd.DataFrame:
    """The node table of the fitted trees, from their saved form; its size is set by the model alone."""
    path = scratch_path(spark, "trees")
    model.trees.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        "nodeData.id",
        "nodeData.prediction",
        F.col("nodeData.impurityStats")[0].alias("weight"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    read = nodes.limit(MAX_NODES + 1).toPandas()
    remove(spark, path)
    if len(read) > MAX_NODES:
        raise ValueError(f"the model has more than {MAX_NODES} nodes")
    return read


def shapley_tables(shares: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Contributions to n leaves with d features each: n by the 2^d patterns of met features by d.

    `shares` holds, per leaf and feature, the part of the weight that takes this path.
    """
    n, d = shares.shape
    patterns = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    out = np.zeros((n, 2**d, d))
    sizes = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    for i in range(d):
        # Coefficient k: total over coalitions of k other features.
        poly = np.zeros((n, 2**d, d))
        poly[:, :, 0] = 1.0
        for j in range(d):
            if j != i:
                larger = poly[:, :, :-1] * patterns[:, j, None]
                poly *= shares[:, j, None, None]
                poly[:, :, 1:] += larger
        gain = patterns[:, i] - shares[:, i, None]
        out[:, :, i] = values[:, None] * gain * (poly @ sizes)
    return out


def read_leaves(nodes: pd.DataFrame, tree_weights: list[float], cuts: list[np.ndarray]) -> list[Leaf]:
    """The leaves of all trees from left to right, with values in log-odds: a boosted score s stands for 2s."""
    leaves = []
    for tree, group in nodes.groupby("tree"):
        rows = {n.id: n for n in group.itertuples(index=False)}
        stack = [(rows[0], {})]
        while stack:
            node, path = stack.pop()
            if node.left < 0:
                leaves.append(Leaf(2.0 * tree_weights[tree] * node.prediction, path))
                continue
            every = (2 << len(cuts[node.feature])) - 1
            ranks, share = path.get(node.feature, (every, 1.0))
            # A value up to the cut has at most the cut's rank.
            below = (2 << int(np.searchsorted(cuts[node.feature], node.threshold))) - 1
            for child, side in ((rows[node.right], ranks & ~below), (rows[node.left], ranks & below)):
                stack.append((child, {**path, node.feature: (side, share * child.weight / node.weight)}))
    return leaves


def refine(classes: list[int], ranks: int) -> list[int]:
    """Split sets of ranks by one more."""
    return [part for c in classes for part in (c & ranks, c & ~ranks) if part]


def share_tables(leaves: list[Leaf], cuts: list[np.ndarray]) -> Iterator[tuple[list[int], dict[int, list[int]]]]:
    """Runs of leaves whose table has at most TABLE_ROWS rows, or one leaf: their numbers, and classes of ranks by feature."""
    run: list[int] = []
    classes: dict[int, list[int]] = {}
    for number, leaf in enumerate(leaves):
        finer = dict(classes)
        for feature, (ranks, _) in leaf.path.items():
            finer[feature] = refine(finer.get(feature, [(2 << len(cuts[feature])) - 1]), ranks)
        if run and prod(map(len, finer.values())) > TABLE_ROWS:
            yield run, classes
            run, finer = [], {f: refine([(2 << len(cuts[f])) - 1], ranks) for f, (ranks, _) in leaf.path.items()}
        run.append(number)
        classes = finer
    if run:
        yield run, classes


def group_codes(cuts: list[np.ndarray], groups: list[list[tuple[int, int]]], adds: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """What the codes of each group add to a row's number, from what the ranks of each feature add."""
    small = np.int16 if sum(int(a.max()) for a in adds.values()) < 1 << 15 else np.intp
    codes = []
    for g, group in enumerate(groups):
        used = [(f, step) for f, step in group if f in adds]
        if used:
            number = np.arange(prod(len(cuts[f]) + 1 for f, _ in group))
            codes.append((g, sum(adds[f][number // step % (len(cuts[f]) + 1)] for f, step in used).astype(small)))
    return codes


def leaf_tables(nodes: pd.DataFrame, tree_weights: list[float], width: int) -> tuple[Tables, float]:
    """The tables of all trees over `width` features and the base value, in log-odds."""
    inner = nodes[nodes["left"] >= 0]
    cuts = [np.unique(inner.loc[inner["feature"] == f, "threshold"].to_numpy(float)) for f in range(width)]
    leaves = read_leaves(nodes, tree_weights, cuts)
    base = sum(leaf.value * prod(share for _, share in leaf.path.values()) for leaf in leaves)
    leaves = [leaf for leaf in leaves if leaf.path]
    if sum(8 * len(leaf.path) << len(leaf.path) for leaf in leaves) > MAX_TABLE_BYTES:
        raise ValueError("the trees are too deep or too many for leaf tables")
    contributed: dict[int, np.ndarray] = {}
    for d in {len(leaf.path) for leaf in leaves}:
        same = [i for i, leaf in enumerate(leaves) if len(leaf.path) == d]
        for at in range(0, len(same), 1024):
            some = same[at : at + 1024]
            shares = np.array([[share for _, share in leaves[i].path.values()] for i in some])
            contributed.update(zip(some, shapley_tables(shares, np.array([leaves[i].value for i in some]))))
    groups = share_codes([len(cut) + 1 for cut in cuts], CODES)
    tables, size = [], 0
    for run, classes in share_tables(leaves, cuts):
        lengths = [len(c) for c in classes.values()]
        rows = np.arange(prod(lengths))
        steps = [prod(lengths[a + 1 :]) for a in range(len(lengths))]
        # The class that each row of the table stands for, by feature.
        held = {f: rows // step % length for f, step, length in zip(classes, steps, lengths)}
        grid = np.zeros((width, len(rows)))
        adds = {}
        for feature, step in zip(classes, steps):
            adds[feature] = np.zeros(len(cuts[feature]) + 1, dtype=np.intp)
            for number, c in enumerate(classes[feature]):
                adds[feature][[r for r in range(len(adds[feature])) if c >> r & 1]] = number * step
        codes = group_codes(cuts, groups, adds)
        size += grid.nbytes + sum(which.nbytes for _, which in codes)
        if size > MAX_TABLE_BYTES:
            raise ValueError("the trees are too deep or too many for shared tables")
        for i in run:
            pattern = np.zeros(len(rows), dtype=np.intp)
            for bit, (feature, (ranks, _)) in enumerate(leaves[i].path.items()):
                pattern += np.array([bool(c & ranks) << bit for c in classes[feature]], dtype=np.intp)[held[feature]]
            for bit, feature in enumerate(leaves[i].path):
                grid[feature] += contributed[i][:, bit][pattern]
        tables.append(Table(codes, np.ascontiguousarray(grid.T)))
    return Tables(cuts, groups, tables), base


def contributions(x: np.ndarray, known: Tables) -> np.ndarray:
    """Rows by features; a value that is no number goes right at every split, as in the trees."""
    out = np.zeros(x.shape)
    for at in range(0, len(x), BLOCK_ROWS):
        block, total = x[at : at + BLOCK_ROWS], out[at : at + BLOCK_ROWS]
        ranks = [np.searchsorted(cut, block[:, f]) for f, cut in enumerate(known.cuts)]
        coded = [sum(ranks[f] * step for f, step in group) for group in known.groups]
        row, found = np.empty(len(block), np.intp), np.empty(block.shape)
        sums = {kind: (np.empty(len(block), kind), np.empty(len(block), kind)) for kind in (np.dtype(np.int16), np.dtype(np.intp))}
        for table in known.tables:
            (first, which), *others = table.codes
            number, part = sums[which.dtype]
            np.take(which, coded[first], out=number, mode="clip")
            for g, which in others:
                number += np.take(which, coded[g], out=part, mode="clip")
            row[:] = number
            total += np.take(table.rows, row, axis=0, out=found, mode="clip")
    return out


def with_attributions(model: FraudModel, scored: DataFrame) -> DataFrame:
    """Add `contributions`, an array of (feature, value) by falling magnitude, four decimals.

    `scored` must come with its `features`. The exact values are kept in
    `exact_contributions`, in feature order; with `base_value` they add up to the
    log-odds of the probability.
    """
    spark = scored.sparkSession
    width = model.trees.numFeatures
    tables, base = leaf_tables(read_nodes(spark, model), model.trees.treeWeights, width)
    shared = spark.sparkContext.broadcast(tables)
    kept = [c for c in scored.columns if c != "features"]
    out_schema = scored.select(*kept, F.array(F.lit(0.0)).alias("exact_contributions")).schema

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            values = pa.array(contributions(x, shared.value).ravel())
            ends = pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32))
            columns = [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, values)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "exact_contributions"])

    exact = scored.mapInArrow(attribute, out_schema).withColumn("base_value", F.lit(float(base)))
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.round(F.col("exact_contributions")[i], 4).alias("value"))
            for i, c in enumerate(S.FEATURE_COLUMNS)
        ]
    )
    # Sorted as structs: a comparison in lambda functions costs more than all else here.
    ranked = F.sort_array(F.transform(pairs, lambda p: F.struct((-F.abs(p["value"])).alias("order"), p["feature"], p["value"])))
    return exact.withColumn("contributions", F.transform(ranked, lambda p: F.struct(p["feature"], p["value"])))


def attributions(attributed: DataFrame, key: str) -> DataFrame:
    """One row per row and feature, ranked by magnitude."""
    return attributed.select(key, F.posexplode("contributions").alias("pos", "c")).select(
        key, (F.col("pos") + 1).alias("rank"), "c.feature", "c.value"
    )


def global_importance(model: FraudModel, scored: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Mean magnitude of each feature's contribution over a fixed sample of n rows."""
    sample = with_attributions(model, hash_sample(scored, n, key, seed))
    exact = sample.select(F.posexplode("exact_contributions").alias("pos", "value"))
    names = F.array(*[F.lit(c) for c in S.FEATURE_COLUMNS])
    return (
        exact.groupBy("pos")
        .agg(F.round(F.avg(F.abs("value")), 4).alias("importance"))
        .select(F.element_at(names, F.col("pos") + 1).alias("feature"), "importance")
        .orderBy(F.desc("importance"), "feature")
    )


def importance_bars(attributed: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The k largest contributions of each row with their bar width in percent and direction."""
    shown = F.slice("contributions", 1, k)
    widest = F.array_max(F.array_append(F.transform(shown, lambda c: F.abs(c["value"])), F.lit(0.001)))
    bars = attributed.select(key, F.posexplode(shown).alias("pos", "c"), widest.alias("widest"))
    value = F.col("c.value")
    return bars.select(
        key,
        (F.col("pos") + 1).alias("rank"),
        "c.feature",
        value.alias("value"),
        (F.abs(value) / F.col("widest") * 100).alias("width"),
        (value > 0).alias("raises_risk"),
    )
