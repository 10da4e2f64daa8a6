"""Streaming operators over transactions in order of arrival.

Each takes and returns a streaming DataFrame; `run_available` drives one to the end
of its input and gives the result as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions import features as X
from tallywing.operators.aggregates import failed
from tallywing.session import scratch_path
from tallywing.sources.fixture import derive_transactions

EVENT_TIME = "event_time"


def stream_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events as they arrive; the table is one file or a folder of files.

    Zone-less times cannot carry a watermark, so `event_time` reads them in the
    session's zone, which should be UTC.
    """
    reader = spark.readStream.schema(S.EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern, because a plain path would have to be a folder.
    events = reader.parquet(f"{sf_dir}/events.parquet*")
    return events.withColumn(EVENT_TIME, F.col("ts").cast("timestamp"))


def stream_transactions(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """Transactions as they arrive; needs no join, so `sender_state` is left out."""
    arrived = derive_transactions(stream_events(spark, sf_dir, files_per_trigger).drop(EVENT_TIME), "arrival")
    return arrived.withColumn(EVENT_TIME, F.col("timestamp").cast("timestamp"))


def _windowed(t: DataFrame, delay: str, length: str, slide: str | None, *keys: str):
    window = F.window(EVENT_TIME, length, slide) if slide else F.window(EVENT_TIME, length)
    return t.withWatermark(EVENT_TIME, delay).groupBy(window.alias("window"), *keys)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in df.columns if c != "window"],
    )


def stream_daily_rollup(t: DataFrame, delay: str = "1 day") -> DataFrame:
    """Count, amount, failures and frauds per day; rows later than `delay` are dropped."""
    return _flat(
        _windowed(t, delay, "1 day", None).agg(
            F.count("*").alias("txn_count"),
            F.sum("amount_inr").alias("total_amount"),
            F.count_if(failed()).alias("failed_count"),
            F.sum("fraud_flag").alias("fraud_count"),
        )
    )


def stream_fraud_stats(
    t: DataFrame, dimension: str, length: str = "1 day", slide: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """Total and frauds per window and value; the rate follows from these."""
    counted = _windowed(t, delay, length, slide, dimension).agg(
        F.count("*").alias("total"), F.sum("fraud_flag").alias("fraud_count")
    )
    rate = F.round(F.try_divide(F.col("fraud_count") * F.lit(100.0), F.col("total")), 2)
    return _flat(counted).withColumn("fraud_rate", rate)


def stream_ttl_dedupe(t: DataFrame, keys: list[str], row_id: str, ttl_seconds: int = 900, delay: str = "1 day") -> DataFrame:
    """Which rows have no other of their key at most `ttl_seconds` before by event time, as `repeat_hits` marks it.

    Time is cut into slots one time to live long, so only the first row of a key and slot can be kept, and it is unless the
    last one of the slot before is too near. Each row therefore counts in its own slot and, by its time alone, in the
    next one; a slot's state is its first row and the latest time before. A late row that comes first replaces the row that was,
    and one that ends the slot before drops it: the result is a row per key and slot, `kept` or not, and the newest counts,
    so the order of rows and batches makes no difference. Of rows at the same time the one with the least `row_id` is the first.

    A key with very many rows is spread over its slots, and a task combines its rows before they are shuffled. Rows whose slot
    has ended more than `delay` before the latest time, and rows without a time, are not seen.
    """
    later = F.col(EVENT_TIME) + F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    places = F.array(F.struct(F.col(EVENT_TIME).alias("at"), F.lit(True).alias("own")), F.struct(later.alias("at"), F.lit(False).alias("own")))
    row = F.struct(*[F.col(c) for c in t.columns])
    spread = t.select(*[F.col(k) for k in keys], row.alias("row"), F.explode(places).alias("place")).select(*keys, "row", "place.*")
    spread = spread.withColumn("row", F.when(F.col("own"), F.col("row")))
    # The copies for the next slot are ahead by one time to live, and so is the watermark.
    marked = spread.withWatermark("at", f"{delay} {ttl_seconds} seconds")
    slots = marked.groupBy(*keys, F.window("at", f"{ttl_seconds} seconds").alias("slot")).agg(
        F.min_by("row", F.when(F.col("own"), F.struct("at", f"row.{row_id}"))).alias("first"),
        F.min(F.when(F.col("own"), F.col("at"))).alias("starts"),
        F.max(F.when(~F.col("own"), F.col("at"))).alias("until"),
    )
    kept = F.col("starts").isNotNull() & (F.col("until").isNull() | (F.col("starts") > F.col("until")))
    others = [F.col(f"first.{c}").alias(c) for c in t.columns if c not in keys]
    return slots.select(*keys, F.col("slot.start").alias("slot"), *others, kept.alias("kept"))


def run_ttl_dedupe(t: DataFrame, keys: list[str], row_id: str, ttl_seconds: int = 900, delay: str = "1 day") -> DataFrame:
    """The rows of the stream that `stream_ttl_dedupe` keeps once all input is processed."""
    done = run_available(stream_ttl_dedupe(t, keys, row_id, ttl_seconds, delay), [*keys, "slot"])
    return done.where("kept").select(*t.columns)


def stream_slot_dedupe(t: DataFrame, keys: list[str], ttl: str = "15 minutes") -> DataFrame:
    """Let each key through once per time slot of length `ttl`; does not depend on batch limits."""
    slotted = t.withColumn("slot", F.window(EVENT_TIME, ttl)["start"])
    return slotted.withWatermark(EVENT_TIME, ttl).dropDuplicates([*keys, "slot"])


def stream_rule_score(t: DataFrame) -> DataFrame:
    """The rule's score of every arriving transaction, stateless."""
    p = X.row_risk_permille() / F.lit(300.0)
    return t.withColumn("fraud_probability", F.round(p, 4)).withColumns({
        "risk_level": X.risk_level(F.col("fraud_probability")),
        "prediction": X.verdict(F.col("fraud_probability")),
    })


def stream_sessions(t: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key, closed after a pause of `gap`."""
    sessions = (
        t.withWatermark(EVENT_TIME, delay)
        .groupBy(key, F.session_window(EVENT_TIME, gap).alias("window"))
        .agg(F.count("*").alias("events"))
    )
    return _flat(sessions)


def _slot_figures(micros: Column) -> list[Column]:
    return [F.min(micros).alias("first"), F.max(micros).alias("last"), F.count("*").alias("n")]


def _join_slots(slots: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Sessions from (key, slot, first, last, n), times in microseconds: slots whose pause is at most the gap belong together."""
    w = W.partitionBy(key).orderBy("slot")
    starts = (F.col("first") - F.lag("last").over(w) > gap_seconds * 1_000_000) | F.lag("last").over(w).isNull()
    numbered = slots.withColumn("new", starts.cast("int")).withColumn(
        "session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))
    )

    def moment(c: Column) -> Column:
        return F.timestamp_micros(c).cast("timestamp_ntz")

    return numbered.groupBy(key, "session").agg(
        moment(F.min("first")).alias("started_at"),
        moment(F.max("last")).alias("last_activity"),
        F.sum("n").alias("events"),
    )


def session_activity(df: DataFrame, key: str, at: str = "ts", gap_seconds: int = 1800) -> DataFrame:
    """The batch form: sessions with first and last activity and size.

    Rows are first combined per key and time slot of one gap length: rows of a slot
    are closer than the gap, so they share a session. What remains to be ordered per
    key is one row per slot, a number set by the calendar and not by the rows.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    slot = F.floor(micros / F.lit(gap_seconds * 1_000_000)).alias("slot")
    return _join_slots(df.groupBy(key, slot).agg(*_slot_figures(micros)), key, gap_seconds)


def stream_session_slots(t: DataFrame, key: str, gap_seconds: int = 1800, delay: str = "1 hour") -> DataFrame:
    """First and last time and size of the rows of a key in each time slot of one gap length, for update mode.

    The built-in session window gives a session only once it has ended, and can't take one back. A slot never moves: a late
    row changes one slot's figures or adds a slot, and the sessions on both sides grow together when the slots are joined.
    The state is a row per key and slot that has not ended more than `delay` before the latest time; rows of older slots may
    be left out, rows without a time are.
    """
    slot = F.window(EVENT_TIME, f"{gap_seconds} seconds").alias("window")
    figures = t.withWatermark(EVENT_TIME, delay).groupBy(key, slot).agg(*_slot_figures(F.unix_micros(EVENT_TIME)))
    return figures.select(key, F.col("window.start").alias("slot"), "first", "last", "n")


def run_sessions(t: DataFrame, key: str, gap_seconds: int = 1800, delay_seconds: int = 3600) -> DataFrame:
    """All sessions of a stream, those still open included: as `session_activity` gives them, and whether they are `closed`.

    A session is closed once the gap after its last row has ended more than the delay before the latest time of the whole
    stream: no row that is still to come can join it. How the input was cut into batches makes no difference to rows that are
    late by at most the delay.
    """
    slots = run_available(stream_session_slots(t, key, gap_seconds, f"{delay_seconds} seconds"), [key, "slot"])
    latest = slots.agg(F.timestamp_micros(F.max("last")).cast("timestamp_ntz"))
    beyond = F.col("last_activity") + F.expr(f"INTERVAL {gap_seconds + delay_seconds} SECONDS")
    return _join_slots(slots, key, gap_seconds).withColumn("closed", beyond < latest.scalar())


def run_available(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Process all input there is and return the result.

    Without `keys` rows are appended to files. With `keys`, the names of the result's
    own key columns, the query runs in update mode: each micro-batch replaces its own
    folder, so a repeated batch changes nothing, and the newest row of each key counts.
    """
    spark = stream.sparkSession
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if keys is None:
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:

        def upsert(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        # An empty first folder stands for a stream that gave nothing.
        spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
        query = writer.outputMode("update").foreachBatch(upsert).start()
    query.awaitTermination()
    if keys is None:
        return spark.read.schema(stream.schema).parquet(path)
    batches = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rest = [c for c in stream.columns if c not in keys]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("r"))
    return newest.select(*keys, "r.*")
