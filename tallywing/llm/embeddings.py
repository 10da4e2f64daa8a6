"""Near-duplicate vectors by Euclidean p-stable hashing, settled by exact cosines.

Unit vectors are projected on random directions, shifted and quantised; `hashes` such numbers make a bucket, `tables`
independent buckets a vector's keys. Both numbers follow from the count of vectors (`plan_hashes`): buckets of unrelated
vectors stay small at any size, and a pair at the threshold meets with the recall asked for.

No bucket is expanded into all its pairs. A vector first joins a cell: the pivot is the least id of one of its buckets to which it
is so close that all members of a cell must be similar to each other. Pairs of cells that share a bucket are then settled by the
triangle inequality on angles where it suffices, and member by member where not, in double precision.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing; vectors of different
lengths don't link; rows of one id are vectors of their own, with links between them only where they are similar; a NULL id
links with nothing; an empty table gives an empty result; equal vectors link; other columns, such as labels, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch
from tallywing.llm.components import components
from tallywing.llm.spans import mix

SIMILAR = 0.9

#: Width of a quantised step, for unit vectors.
WIDTH = 2.0

#: Share of pairs exactly at the threshold that meet in a bucket; closer pairs meet more often.
RECALL = 0.995

#: What angles may be off by.
SLACK = 1e-6


def step_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at this distance fall into the same step of one random direction."""
    r = width / distance
    far = math.erfc(r / math.sqrt(2)) / 2
    return 1 - 2 * far - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_hashes(n: int, similar: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(hashes, tables): a bucket holds about one unrelated vector, and pairs at the threshold meet."""
    near, far = step_chance(math.sqrt(2 - 2 * similar)), step_chance(math.sqrt(2))
    hashes = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))


@cache
def _directions(size: int, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([size, hashes, tables])
    return rng.standard_normal((size, hashes * tables)), rng.uniform(0, WIDTH, hashes * tables)


def _bucket_keys(unit: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    directions, shift = _directions(unit.shape[1], hashes, tables)
    steps = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, hashes)
    key = np.broadcast_to(mix(np.arange(tables, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(unit.shape[1])), steps.shape[:2])
    for i in range(hashes):
        key = mix(key ^ steps[:, :, i])
    return key.view(np.int64)


def bucketed(vectors: DataFrame, hashes: int, tables: int) -> DataFrame:
    """(row, vec_id, unit, keys) of every vector, in double precision; unit and keys are NULL where it can't link."""

    names = ["row", "vec_id", "unit", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, rows = part.column("vec_id").to_pylist(), part.column("embedding").to_pylist()
                sizes: dict[int, list[int]] = {}
                alone: list[int] = []
                arrays = [np.array(r or [], np.float64) for r in rows]  # NULL components become nan
                for i, a in enumerate(arrays):
                    if ids[i] is not None and len(a) and np.isfinite(a).all() and a.any():
                        sizes.setdefault(len(a), []).append(i)
                    else:
                        alone.append(i)
                if alone:
                    nothing = (pa.nulls(len(alone), pa.list_(kind)) for kind in (pa.float64(), pa.int64()))
                    yield pa.record_batch([part.column("row").take(pa.array(alone)), part.column("vec_id").take(pa.array(alone)), *nothing], names)
                for which in sizes.values():
                    m = np.stack([arrays[i] for i in which])
                    m /= np.abs(m).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
                    unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
                    keys = _bucket_keys(unit, hashes, tables)
                    yield pa.record_batch(
                        [part.column("row").take(pa.array(which)), part.column("vec_id").take(pa.array(which)), *(
                            pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                            for x in (unit, keys)
                        )],
                        names,
                    )

    return vectors.mapInArrow(run, "row long, vec_id long, unit array<double>, keys array<long>")


def _with_cosine(df: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and `cosine`, of the unit vectors in columns a and b."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(a), batch.column(b)
            first = x.offsets.to_numpy() - x.offsets[0].as_py() if len(x) else np.zeros(1, int)
            total = np.concatenate([x.flatten().to_numpy() * y.flatten().to_numpy(), [0.0]])
            cosine = np.add.reduceat(total, first[:-1]) if len(x) else np.zeros(0)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(cosine)], [*keep, "cosine"])

    return df.mapInArrow(run, f"{schema}, cosine double")


def _angle(cosine: str = "cosine") -> Column:
    return F.acos(F.least(F.greatest(F.col(cosine), F.lit(-1.0)), F.lit(1.0)))


def cells_of(own: DataFrame, similar: float) -> DataFrame:
    """(row, cell, angle): each vector's cell and its angle to the pivot, at most half the linking angle."""
    near = math.cos(math.acos(similar) / 2 - SLACK)
    keys = own.select("row", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("row").alias("pivot"), F.max("row").alias("other")).where("pivot != other").drop("other")
    offers = keys.join(least, "key").where("row != pivot").select("row", "pivot").distinct()
    units = own.select("row", "unit")
    both = offers.join(units, "row").join(units.toDF("pivot", "pivot_unit"), "pivot")
    close = _with_cosine(both, "unit", "pivot_unit", ["row", "pivot"]).where(F.col("cosine") >= near)
    best = close.groupBy("row").agg(F.min(F.struct("pivot", "cosine")).alias("b"))
    return own.select("row").join(best, "row", "left").select(
        "row", F.coalesce("b.pivot", "row").alias("cell"), F.when(F.col("b").isNull(), 0.0).otherwise(_angle("b.cosine")).alias("angle")
    )


def near_duplicates(
    vectors: DataFrame, similar: float = SIMILAR, recall: float = RECALL, plan: Callable[..., tuple[int, int]] = plan_hashes
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links found between all vectors, a row per vector."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    # A row's number within this run tells rows of one id apart; it is written together with all else.
    numbered = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    hashes, tables = plan(vectors.count(), similar, recall)
    rows, own_path = scratch.write(bucketed(numbered, hashes, tables), "own")
    own = rows.where("unit IS NOT NULL").drop("vec_id")
    member, _ = scratch.write(cells_of(own, similar), "members")
    cells, cell_path = scratch.write(
        member.groupBy("cell").agg(F.count("*").alias("size"), F.max("angle").alias("radius")).join(
            own.select(F.col("row").alias("cell"), F.col("unit").alias("pivot")), "cell"
        ),
        "cells",
    )

    # Cells that share a bucket. A bucket's vectors are reduced to its cells before they meet.
    spots = own.select("row", F.explode("keys").alias("key")).join(member.select("row", "cell"), "row").select("key", "cell").distinct()
    pairs = spots.join(spots.toDF("key", "cell_b"), "key").where("cell < cell_b").select("cell", "cell_b").distinct()
    limit = math.acos(similar)
    ends = pairs.join(cells, "cell").join(cells.toDF("cell_b", "size_b", "radius_b", "pivot_b"), "cell_b")
    seen = _with_cosine(ends, "pivot", "pivot_b", ["cell", "cell_b", "size", "size_b", "radius", "radius_b"]).withColumn("between", _angle())
    reach = F.col("radius") + F.col("radius_b")
    single = (F.col("size") == 1) & (F.col("size_b") == 1)
    kind = (
        F.when(single, F.when(F.col("cosine") >= similar, "all").otherwise("none"))
        .when(F.col("between") + reach <= limit - SLACK, "all")
        .when(F.col("between") - reach > limit + SLACK, "none")
        .otherwise("some")
    )
    settled, settled_path = scratch.write(seen.withColumn("kind", kind).where("kind != 'none'"), "pairs")
    whole = settled.where("kind = 'all'")
    per_cell = (
        whole.select("cell", F.col("size_b").alias("n"))
        .union(whole.select("cell_b", "size"))
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
    )

    # Member by member: first against the other cell's pivot, then, where that doesn't tell, against its members.
    open_ = settled.where("kind = 'some'").select("cell", "cell_b")
    open_ = open_.union(open_.select("cell_b", "cell")).join(cells.toDF("cell_b", "size_b", "radius_b", "pivot_b"), "cell_b")
    units = own.select("row", "unit").join(member.select("row", "cell"), "row")
    against = _with_cosine(open_.join(units, "cell"), "unit", "pivot_b", ["row", "cell", "cell_b", "size_b", "radius_b"])
    against = against.withColumn("between", _angle()).withColumn(
        "kind",
        F.when(F.col("size_b") == 1, F.when(F.col("cosine") >= similar, "all").otherwise("none"))
        .when(F.col("between") + F.col("radius_b") <= limit - SLACK, "all")
        .when(F.col("between") - F.col("radius_b") > limit + SLACK, "none")
        .otherwise("some"),
    )
    against, against_path = scratch.write(against.where("kind != 'none'").select("row", "cell", "cell_b", "size_b", "kind"), "against")
    others = units.toDF("other", "other_unit", "cell_b")
    each = against.where("kind = 'some'").select("row", "cell", "cell_b").join(others, "cell_b").join(own.select("row", "unit"), "row")
    each = _with_cosine(each, "unit", "other_unit", ["row", "cell", "cell_b"]).where(F.col("cosine") >= similar)
    linked, _ = scratch.write(
        against.where("kind = 'all'").select("row", "cell", "cell_b", F.col("size_b").alias("n")).union(
            each.groupBy("row", "cell", "cell_b").agg(F.count("*").alias("n"))
        ),
        "linked",
    )
    edges = member.select(F.col("row").alias("a"), F.col("cell").alias("b")).union(whole.select("cell", "cell_b")).union(
        linked.select("cell", "cell_b")
    )
    groups = components(edges, scratch)
    found = (
        member.join(cells.select("cell", F.col("size") - 1), "cell")
        .toDF("cell", "row", "angle", "own_n")
        .join(per_cell, "cell", "left")
        .join(linked.groupBy("row").agg(F.sum("n").alias("m")), "row", "left")
        .select("row", (F.col("own_n") + F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n_links"))
    )
    # Written, so that the tables that only the steps above need can go.
    counted = rows.select("row", "vec_id").join(found, "row", "left").join(groups.withColumnRenamed("id", "row"), "row", "left")
    counted, _ = scratch.write(counted, "counted")
    scratch.drop(own_path, cell_path, settled_path, against_path)
    least = counted.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    return (
        counted.join(least, "component", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
