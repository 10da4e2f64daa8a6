"""How quality filters interact: what each removes in every order of application, by incremental retraction streaming.

Five filters look at whole texts. A text fails A with fewer than 100 words, B when less than 80 % of its words are distinct, C
when more than 10 % of its code points are A-Z, D when it holds one of #$%&*|, and E when a smaller doc_id has the same
text, anywhere in the table. Which a row fails is its mask, a bit per filter.

The files of the table are a stream, read to its end in a fixed number of micro-batches. A to D follow from a text alone. E
may change: the state of a text (keyed by its SHA-256) is the smallest id so far and what the rows with it are counted as.
Rows with a larger id fail E at once; when a smaller id arrives, the rows counted before are retracted from the mask without E
and counted under the one with it. The states of about BUCKET texts are one row of the state store, and change together. Every micro-batch writes the sums of its changes per part, mask and label to a folder of its own,
which a repeated micro-batch overwrites; the sum over all folders is the same whatever the order of files and batches.

`interactions` derives all orders from these counters, at most 32 masks a part: a step removes the rows that fail its
filter and none before it.

A text that fills a third of the table is one key, so rows are combined before they are shuffled: a task sends one row for each
of its texts, parts and labels. Words are counted in the JVM; the state is in RocksDB, not in memory.

Defined cases: a NULL text counts as the empty one, which fails A only (and E after the first); a NULL lang is the
part ""; rows with the same id and text are all the first, or all not; a row with a NULL id never fails E and makes no other
row fail it; labels that are NULL, or of unknown documents, count as 0, and of several labels of one id the largest counts; an empty table
gives an empty result; only doc_id, text and lang are read, whatever else the files hold.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywing.llm.common import Scratch
from tallywing.session import scratch_path

FILTERS = "ABCDE"

#: Bit of the filter that depends on other rows.
REPEATED = 1 << FILTERS.index("E")

#: Micro-batches that a table is read in.
BATCHES = 4

#: Bits of `flags`.
GOOD, TOXIC = 1, 2

WORD_BORDER = "[\\x20\\x09-\\x0D]+"

DOCS = "doc_id long, text string, lang string"

#: Texts, parts and labels of a task that are combined at a time.
PENDING = 100_000

#: Rows of the table for each bucket of texts; the number of buckets follows from the number of rows.
BUCKET = 2_000


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; the text is not NULL."""
    words = F.filter(F.split(text, WORD_BORDER), lambda w: w != "")
    n = F.size(words)
    fails = [
        n < 100,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * n,
        F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(10) * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def flags_of(labels: DataFrame) -> DataFrame:
    """(id, flags) of the labelled documents with quality or toxic 1, a row per id."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id is not null and (quality = 1 or toxic = 1)")
    good, toxic = (F.max(F.when(F.col(c) == 1, bit).otherwise(0)) for c, bit in (("quality", GOOD), ("toxic", TOXIC)))
    return known.groupBy("id").agg((good + toxic).cast("int").alias("flags"))


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one text, part and label as one: the least id, how many rows have it, and how many rows there are."""
    by = ["key", "part", "flags", "mask", "named"]

    def fold(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        least = rows.groupby(by, sort=False)["low"].transform("min")
        rows["firsts"] = rows["firsts"].where(rows["low"] == least, 0)
        return rows.groupby(by, sort=False, as_index=False).agg({"low": "min", "firsts": "sum", "n": "sum"})

    pending, size = [], 0
    for pdf in frames:
        if len(pdf):
            pending.append(fold([pdf]))
            size += len(pending[-1])
        if size > PENDING:
            pending = [fold(pending)]
            size = len(pending[0])
            if size > PENDING // 2:
                yield pending.pop()
                size = 0
    if pending:
        yield fold(pending)


def _changes(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the new rows of a bucket of texts.

    The state holds, for each text, the least id so far and the rows that have it. Where a smaller id arrives, the old rows
    are retracted: they fail E from now on.
    """
    new = pd.concat(list(frames), ignore_index=True).drop(columns="bucket")
    named = new["named"].to_numpy()
    by = ["part", "flags", "mask"]
    changes = [new[by].assign(mask=new["mask"] | np.where(named, REPEATED, 0), n=new["n"])]
    own = ["key", "low", *by, "firsts"]
    rows = new.loc[named, own]
    if len(rows):
        old = pd.read_feather(io.BytesIO(state.get[0])) if state.exists else rows.iloc[:0]
        both = pd.concat([old, rows], ignore_index=True)
        first = (both["low"] == both.groupby("key", sort=False)["low"].transform("min")).to_numpy()
        was = np.arange(len(both)) < len(old)
        for which, sign in ((was & ~first, -1), (~was & first, 1)):
            moved = both.loc[which]
            changes.append(moved[by].assign(n=sign * moved["firsts"]))
            changes.append(moved[by].assign(mask=moved["mask"] | REPEATED, n=-sign * moved["firsts"]))
        kept = both[first].groupby(["key", "low", *by], sort=False, as_index=False)["firsts"].sum()
        raw = io.BytesIO()
        kept.to_feather(raw, compression="zstd")
        state.update((raw.getvalue(),))
    yield pd.concat(changes, ignore_index=True).groupby(by, sort=False, as_index=False)["n"].sum()


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Within it, streams keep their state in RocksDB with a bounded share of memory."""
    base = "spark.sql.streaming.stateStore."
    wanted = {
        base + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        base + "rocksdb.boundedMemoryUsage": "true",
        base + "rocksdb.maxMemoryUsageMB": "256",
        base + "rocksdb.changelogCheckpointing.enabled": "true",
        base + "rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def masked(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """(key, part, flags, mask, named, low, firsts, n) of every row, those of one task combined. `docs` may be a stream."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text, 256)).alias("key"), F.coalesce("lang", F.lit("")).alias("part"), own_mask(text).alias("mask"), "doc_id",
    ).join(flags, F.col("doc_id") == F.col("id"), "left")
    one = F.lit(1).cast("long")
    rows = rows.select(
        "key", "part", F.coalesce("flags", F.lit(0)).alias("flags"), "mask", F.col("doc_id").isNotNull().alias("named"),
        F.coalesce("doc_id", F.lit(0)).alias("low"), one.alias("firsts"), one.alias("n"),
    )
    return rows.mapInPandas(_combine, "key binary, part string, flags int, mask int, named boolean, low long, firsts long, n long")


def counters(spark: SparkSession, files: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(part, flags, mask, n): rows of each part by what they fail, from the Parquet files of the pattern `files`."""
    scratch = Scratch(spark, "audit")
    flags, flags_path = scratch.write(flags_of(labels), "flags")
    found = len(spark.read.schema(DOCS).parquet(files).inputFiles())
    docs = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", max(1, -(-found // batches))).parquet(files)
    buckets = spark.read.schema(DOCS).parquet(files).count() // BUCKET + 1
    rows = masked(docs, flags).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    changes = rows.groupBy("bucket").applyInPandasWithState(
        _changes, "part string, flags int, mask int, n long", "texts binary", "update", GroupStateTimeout.NoTimeout
    )
    folder, progress = scratch_path(spark, "audit-changes"), scratch_path(spark, "audit-progress")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "flags", "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    with _state_on_disk(spark):
        stream = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", progress)
        stream.trigger(availableNow=True).start().awaitTermination()
    schema = "part string, flags int, mask int, n long"
    written = spark.createDataFrame([], schema)
    if scratch.exists(folder):
        written = spark.read.schema(schema).parquet(f"{folder}/batch=*")
    total, _ = scratch.write(written.groupBy("part", "flags", "mask").agg(F.sum("n").alias("n")).where("n != 0"), "counters")
    scratch.drop(flags_path, folder, progress)
    return total


def interactions(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders.

    Each part's counters become arrays of 32 places, one for each mask; sums over masks give every column.
    """
    zero = "transform(sequence(0, 31), i -> 0L)"
    sums = {
        "every": F.col("n"), "good": F.when(F.col("flags").bitwiseAND(GOOD) > 0, F.col("n")).otherwise(0),
        "toxic": F.when(F.col("flags").bitwiseAND(TOXIC) > 0, F.col("n")).otherwise(0),
    }
    per_mask = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    place = "map_from_entries(collect_list(struct(mask, {0})))"
    parts = per_mask.groupBy("part").agg(*[F.expr(place.format(k)).alias(k) for k in sums])
    parts = parts.select("part", *[F.expr(f"transform({zero}, (z, i) -> coalesce({k}[i], z))").alias(k) for k in sums])
    # The 600 pairs of an order and a step, with the bits of the step's filter and of those before.
    steps = [
        (order, i + 1, 1 << FILTERS.index(order[i]), sum(1 << FILTERS.index(c) for c in order[:i]))
        for order in map("".join, permutations(FILTERS)) for i in range(len(FILTERS))
    ]
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("own"), F.lit(e).alias("earlier")) for o, s, b, e in steps])
    rows = parts.withColumn("plan", F.explode(plan)).select("*", "plan.*").drop("plan")

    def total(column: str, condition: str) -> Column:
        return F.expr(f"aggregate(sequence(0, 31), 0L, (a, i) -> a + if({condition}, {column}[i], 0L))")

    here = "(i & own) != 0 and (i & earlier) = 0"
    rows = rows.select(
        "part", "filter_order", "step", "own",
        total("every", "(i & (own | earlier)) = 0").alias("kept"),
        total("every", here).alias("removed"),
        total("every", "(i & own) != 0 and (i & earlier) != 0").alias("redundant"),
        total("every", "i = own").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    all_orders = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return rows.join(all_orders, ["part", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(spark: SparkSession, files: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """`interactions` of the rows in the Parquet files of the pattern `files` (doc_id, text, lang)."""
    return interactions(counters(spark, files, labels, batches))
