"""Top-k, last-n per group and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of a total order; runs as a per-partition top-n with a small merge."""
    return df.orderBy(*order).limit(n)


def first_per_group(df: DataFrame, keys: list[str], n: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1.

    Filtering on `row_number` lets Spark keep n rows per group and task before it
    shuffles, so a very large group does not reach one task whole.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def by_magnitude(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), *ties)


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The same n rows on every run and every layout of the data; n is report-sized."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return top(df, n, order, F.col(key))
