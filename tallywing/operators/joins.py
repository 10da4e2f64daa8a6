"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(fact: DataFrame, dimension: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join a fact frame to a dimension with one row per key.

    No broadcast is forced: the planner broadcasts a dimension whose known size is
    below `spark.sql.autoBroadcastJoinThreshold`, and otherwise sorts and merges,
    where the adaptive skew handling splits an overfull fact partition (the
    dimension side has one row per key, so repeating its partition is cheap).
    """
    return fact.join(dimension, key, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL, as windows and groups take it. `right` has its other columns to itself."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"__right_{k}" for k in keys])


def dictionary_lookup(df: DataFrame, dictionary: DataFrame, columns: list[str], bound: int = 10_000) -> DataFrame:
    """Add `<column>_code` for each listed column from `(column, value, code)`; unknown gives 0.

    The dictionary is broadcast only when counted to hold at most `bound` rows;
    beyond that the planner chooses the join.
    """
    small = dictionary.limit(bound + 1).count() <= bound
    out = df
    for c in columns:
        codes = dictionary.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").alias(f"{c}_code")
        )
        codes = F.broadcast(codes) if small else codes
        out = out.join(codes, F.col(c).cast("string") == F.col("__value"), "left").drop("__value")
    return out.withColumns({f"{c}_code": F.coalesce(f"{c}_code", F.lit(0)) for c in columns})


def cascade_delete(
    parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str, child_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the deleted parents and their children."""
    child_key = child_key or key
    gone = deleted.select(key).distinct()
    kept_children = children.join(gone.withColumnRenamed(key, child_key), child_key, "left_anti")
    return parents.join(gone, key, "left_anti"), kept_children


def children_of(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The child rows whose parent is listed."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    name: str,
    span: int = 1024,
    levels: int = 2,
) -> DataFrame:
    """The latest non-NULL `value` at a strictly smaller `order` within each key.

    Each key is cut into stretches of `span` order units, so that a key with very
    many rows is spread over tasks. Within a stretch a window finds the value; one
    row per stretch carries the last value into the stretches that follow, which is
    the same problem on a `span`-th of the rows and is solved the same way.
    `order` must be a whole number and unique within a key.
    """
    found = df.withColumn("__value", value)
    if levels == 0:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return found.withColumn(name, F.last("__value", ignorenulls=True).over(w)).drop("__value")
    stretch, carried = f"__stretch{levels}", f"__carried{levels}"
    cut = found.withColumn(stretch, F.expr(f"`{order}` div {span}"))
    within = W.partitionBy(*keys, stretch).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("__inside", F.last("__value", ignorenulls=True).over(within))
    ends = cut.groupBy(*keys, stretch).agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__latest")
    )
    starts = carry_forward(ends, keys, stretch, F.col("__latest"), carried, span, levels - 1)
    starts = starts.filter(F.col(carried).isNotNull()).drop("__latest")
    return (
        null_safe_join(local, starts, [*keys, stretch])
        .withColumn(name, F.coalesce("__inside", carried))
        .drop(stretch, "__inside", carried, "__value")
    )


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames whose columns differ; a missing column is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
