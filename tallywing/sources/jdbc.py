"""Relational databases: partitioned reads, query pushdown and batched loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A whole table; with a numeric `column` and its `bounds` it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partitions > 1:
        if column is None or bounds is None:
            raise ValueError("a parallel read needs a numeric column and its bounds")
        reader = reader.options(
            partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


def time_slices(column: str, edges: list[str]) -> list[str]:
    """Predicates that cover every row once: before, between and after the edges, and NULL."""
    if not edges or edges != sorted(set(edges)):
        raise ValueError("edges must be distinct and ascending")
    inner = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(edges, edges[1:])]
    return [f"{column} < '{edges[0]}' OR {column} IS NULL", *inner, f"{column} >= '{edges[-1]}'"]


def read_table_by_time(
    spark: SparkSession, url: str, table: str, column: str, edges: list[str], **options: str
) -> DataFrame:
    """A whole table, one task per time slice, for tables without a numeric key."""
    return spark.read.jdbc(url, table, predicates=time_slices(column, edges), properties=options)


def read_pushed_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query the database itself runs."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def load_table(
    df: DataFrame, url: str, table: str, batch: int = 5000, if_nonempty: str = "fail", exists: bool = True, **options: str
) -> None:
    """Insert in batches; `if_nonempty` says whether rows already there stop the load or are cut first."""
    if if_nonempty not in ("fail", "truncate"):
        raise ValueError("if_nonempty must be 'fail' or 'truncate'")
    if exists and if_nonempty == "fail":
        present = df.sparkSession.read.format("jdbc").options(url=url, dbtable=table, **options).load()
        if present.limit(1).count():
            raise RuntimeError(f"{table} already has rows")
    writer = df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options)
    if exists and if_nonempty == "truncate":
        writer.option("truncate", "true").mode("overwrite").save()
    else:
        writer.mode("append").save()
