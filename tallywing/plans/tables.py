"""Sources and sinks, as round trips of the whole transaction table through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions import dates as D
from tallywing.operators.fraud_model import FraudModel, score
from tallywing.plans.corpus import rows, total_amount
from tallywing.plans.dashboard import d05_fraud_dashboard
from tallywing.plans.models import trained_model
from tallywing.plans.registry import REGISTRY, register
from tallywing.session import scratch_path
from tallywing.sources import files as IO
from tallywing.sources.fixture import table, transactions, with_transactions

ALL_ROWS = with_transactions(
    """SELECT * EXCLUDE (risk) REPLACE (strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp") FROM transactions"""
)


def as_text(t: DataFrame) -> DataFrame:
    return t.withColumn("timestamp", D.iso_text(F.col("timestamp")))


@register("s01_load_raw_csv", ALL_ROWS)
def s01_load_raw_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw file with its own headers to the enriched table."""
    path = scratch_path(spark, "raw")
    IO.write_raw_csv(transactions(spark, sf_dir), path)
    return as_text(IO.load_raw(spark, path))


# Every fifth event becomes a raw line with one fault: an amount that is no number, a time that is none, a field too
# few or a field too many.
FAULTY_SQL = """SELECT reason, count(*) AS lines, count(DISTINCT line) AS different FROM (
  SELECT 'TXN' || event_id || CASE event_id // 5 % 4 WHEN 0 THEN ',2024-10-08 15:17:28,much' WHEN 1 THEN ',noon,868'
         WHEN 2 THEN ',2024-10-08 15:17:28' ELSE ',2024-10-08 15:17:28,868,x' END AS line,
         CASE event_id // 5 % 4 WHEN 0 THEN 'amount (INR)' WHEN 1 THEN 'timestamp' ELSE 'field count' END AS reason
  FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT 'none', 'kept' FROM events WHERE event_id % 5 <> 0
) GROUP BY 1"""


@register("s01_rejected_lines", FAULTY_SQL)
def s01_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not fit by reason, and those that do, of a raw file made from all events."""
    path, e = scratch_path(spark, "faulty"), F.col("event_id")
    fault = F.expr("event_id div 5 % 4")
    tail = (
        F.when(e % 5 != 0, ",2024-10-08 15:17:28,868")
        .when(fault == 0, ",2024-10-08 15:17:28,much")
        .when(fault == 1, ",noon,868")
        .when(fault == 2, ",2024-10-08 15:17:28")
        .otherwise(",2024-10-08 15:17:28,868,x")
    )
    # Each task writes one file, whose first line is the header.
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    head = F.when(first, "transaction id,timestamp,amount (INR)\n").otherwise("")
    lines = table(spark, sf_dir, "events").select(F.concat(head, F.lit("TXN"), e.cast("string"), tail).alias("value"))
    lines.write.text(path)
    bad = IO.rejected_lines(spark, path).groupBy("reason").agg(rows("lines"), F.countDistinct("line").alias("different"))
    good = IO.read_transactions_csv(spark, path).where(F.col(S.CORRUPT_COLUMN).isNull())
    return bad.union(good.agg(F.lit("kept"), F.count("*"), F.lit(1).cast("long")))


@register(
    "s02_rename_source_columns",
    with_transactions(
        """SELECT transaction_type, count(*) AS count, CAST(sum(amount_inr) AS BIGINT) AS total_amount,
                  max(transaction_id) AS last_id FROM transactions GROUP BY 1"""
    ),
)
def s02_rename_source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = transactions(spark, sf_dir).withColumnsRenamed({v: k for k, v in S.SOURCE_RENAMES.items()})
    renamed = IO.rename_source_columns(raw)
    return renamed.groupBy("transaction_type").agg(rows(), total_amount(), F.max("transaction_id").alias("last_id"))


@register("s05_write_table_replace", ALL_ROWS)
def s05_write_table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written over an older one."""
    path = scratch_path(spark, "table")
    t = transactions(spark, sf_dir)
    IO.write_table_replace(t.filter("fraud_flag = 1"), path)
    IO.write_table_replace(t, path)
    return as_text(IO.read_table_files(spark, path, S.TRANSACTIONS))


@register("s06_write_csv", ALL_ROWS)
def s06_write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched table as CSV."""
    path = scratch_path(spark, "csv")
    IO.write_csv(transactions(spark, sf_dir), path)
    return as_text(IO.read_transactions_csv(spark, path).drop(S.CORRUPT_COLUMN).select(*S.TRANSACTION_COLUMNS))


@register(
    "s08_cluster_for_access",
    with_transactions(
        """SELECT sender_bank, count(*) AS count, CAST(sum(amount_inr) AS BIGINT) AS total_amount
           FROM transactions WHERE "timestamp" >= '2024-06-01' AND "timestamp" < '2024-07-01' GROUP BY 1"""
    ),
)
def s08_cluster_for_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month per bank from the table kept by day."""
    path = scratch_path(spark, "clustered")
    IO.cluster_for_access(transactions(spark, sf_dir, with_state=False), path)
    june = IO.between_days(spark.read.parquet(path), "2024-06-01", "2024-06-30")
    return june.groupBy("sender_bank").agg(rows(), total_amount())


def _for_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lookup")
    IO.write_for_lookup(transactions(spark, sf_dir, with_state=False), path)
    return spark.read.parquet(path)


@register(
    "s08_lookup_by_id",
    with_transactions(
        """SELECT transaction_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", amount_inr, sender_bank, fraud_flag
           FROM transactions WHERE transaction_id IN ('TXN0000000042', 'TXN0000000777')"""
    ),
)
def s08_lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payments by their ids, from the table with Bloom filters."""
    found = _for_lookup(spark, sf_dir).where(F.col("transaction_id").isin("TXN0000000042", "TXN0000000777"))
    return as_text(found.select("transaction_id", "timestamp", "amount_inr", "sender_bank", "fraud_flag"))


@register(
    "s08_lookup_by_flag",
    with_transactions(
        """SELECT sender_bank, count(*) AS count, CAST(sum(amount_inr) AS BIGINT) AS total_amount
           FROM transactions WHERE fraud_flag = 1 GROUP BY 1"""
    ),
)
def s08_lookup_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frauds of all days per bank, from the table that lies along a curve over bank, hour and flag."""
    return _for_lookup(spark, sf_dir).where("fraud_flag = 1").groupBy("sender_bank").agg(rows(), total_amount())


@register("s09_write_json_report", REGISTRY["d05_fraud_dashboard"].oracle)
def s09_write_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fraud dashboard as a JSON report."""
    path = scratch_path(spark, "report")
    report = d05_fraud_dashboard(transactions(spark, sf_dir, with_state=False))
    IO.write_json_report(report, path)
    return spark.read.schema(report.schema).json(path)


@register("s10_save_load_model")
def s10_save_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a model saved once more and loaded again, by outcome."""
    path = scratch_path(spark, "model-copy")
    trained_model(spark, sf_dir).save(path)
    scored = score(FraudModel.load(spark, path), transactions(spark, sf_dir))
    return scored.groupBy("prediction", "risk_level").agg(rows())
