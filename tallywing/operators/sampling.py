"""Class-preserving splits and label dictionaries for model training."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows are placed by the first four hex digits of their hash: 65,536 bins per class.
BIN_DIGITS = 4


def _class_of(label: str) -> Column:
    """A label as text; NULL is a class of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Mark each row in `is_test`; every class keeps its share to the row, a NULL label being a class.

    One row per class reaches the driver, whatever the number of rows.

    Rows are ranked by a hash of the unique `key`, and the highest ranks of each
    class become the test set. The training size is n - ceil(n * share), divided
    over the classes by largest remainder. Two small jobs find the hash at which
    each class is cut: the first counts rows per class and hash bin, the second
    ranks the rows of the one bin per class in which the cut falls. The split
    itself then compares each row with its class's cut and needs no shuffle.
    """
    hashed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    rows = df.select(_class_of(label).alias("y"), F.col(key).alias("k"), hashed.alias("h"))
    rows = rows.withColumn("bin", F.substring("h", 1, BIN_DIGITS))
    bins = rows.groupBy("y", "bin").agg(F.count("*").alias("c")).persist()
    cuts = _cut_bins(bins, test_share)
    bins.unpersist()
    # A class without training rows has no cut: all of it is test.
    last = _last_training_rows(rows, cuts) if cuts else []
    if not last:
        return df.withColumn("is_test", F.lit(True))
    kind = df.schema[key].dataType
    edge = _by_class({r["y"]: F.struct(F.lit(r["h"]).alias("h"), F.lit(r["k"]).cast(kind).alias("k")) for r in last})
    place = F.struct(hashed.alias("h"), F.col(key).alias("k"))
    return df.withColumn("is_test", F.coalesce(place > F.try_element_at(edge, _class_of(label)), F.lit(True)))


def _by_class(values: dict) -> Column:
    """A literal map from class to value."""
    return F.create_map(*[c for y, v in values.items() for c in (F.lit(y), v)])


def _last_training_rows(rows: DataFrame, cuts: list[Row]) -> list[Row]:
    """Per class the row at the end of its training quota, from the rows of its cut bin."""
    bins = _by_class({c["y"]: F.lit(c["bin"]) for c in cuts})
    ranks = _by_class({c["y"]: F.lit(c["quota"] - c["below"]) for c in cuts})
    rank = F.row_number().over(W.partitionBy("y").orderBy("h", "k"))
    # The hash alone rules out nearly every row before the label has to be computed;
    # null-safe tests keep the planner from adding label tests in front of it.
    near = rows.filter(F.col("bin").isin([c["bin"] for c in cuts]))
    edge = near.filter(F.col("bin").eqNullSafe(F.try_element_at(bins, F.col("y")))).withColumn("__rank", rank)
    last = edge.filter(F.col("__rank").eqNullSafe(F.try_element_at(ranks, F.col("y"))))
    return last.select("y", "h", "k").collect()


def _cut_bins(bins: DataFrame, test_share: float) -> list[Row]:
    """Per class, the bin in which its training quota is reached and the rows below it.

    A class without training rows has no cut.
    """
    running = W.partitionBy("y").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sizes = {r["y"]: r["n"] for r in bins.groupBy("y").agg(F.sum("c").alias("n")).collect()}
    total = sum(sizes.values())
    train = total - math.ceil(total * test_share)
    quota = {y: n * train // total for y, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda y: (-(sizes[y] * train % total), y))
    for y in by_rest[: train - sum(quota.values())]:
        quota[y] += 1
    if not quota:
        return []
    wanted = F.try_element_at(_by_class({y: F.lit(n) for y, n in quota.items()}), F.col("y"))
    placed = bins.withColumn("below", F.coalesce(F.sum("c").over(running), F.lit(0))).withColumn("quota", wanted)
    reached = (F.col("below") < F.col("quota")) & (F.col("below") + F.col("c") >= F.col("quota"))
    return placed.filter(reached).collect()


def hash_share(key: str, seed: int = 42) -> Column:
    """A fixed number from 0 to below 1 per key, spread evenly."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def quick_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark about `test_share` of the rows of any class in `is_test`, in one pass without counting."""
    return df.withColumn("is_test", hash_share(key, seed) < F.lit(test_share))


def fit_label_encoder(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): codes count up from 0 in sorted order of the values; NULL is 'Unknown'."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("value"))
            for c in columns
        ]
    )
    # Combinations first: what is unfolded is one row per combination, not per row of the table.
    values = df.select(*columns).distinct().select(F.explode(pairs).alias("p")).select("p.*").distinct()
    code = F.row_number().over(W.partitionBy("column").orderBy("value")) - 1
    return values.withColumn("code", code)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Class sizes and the weight of a positive row, negatives over positives."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")
    ).withColumn("weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives")))
