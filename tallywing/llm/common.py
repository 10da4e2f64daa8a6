"""What several operators of this package share: tables, scratch tables, held-out rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


def rows_by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` whose doc_id is in the one column of `ids` ("left_semi") or isn't ("left_anti"), with all their
    columns, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"))
    return rows.join(ids.toDF("other_id"), F.col("own_id") == F.col("other_id"), how).select(*[F.col(f"row.`{c}`") for c in docs.columns])


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Within it, what Spark sends to Python at a time has about `size` bytes; for tables of few, very wide rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written below the shared folder; those not needed by a result can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def drop(self, *paths: str) -> None:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
