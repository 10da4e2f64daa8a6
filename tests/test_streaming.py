import random
from datetime import timezone

from pyspark.sql import functions as F

from tallywing.operators.conversations import repeat_hits
from tallywing.sources.fixture import derive_transactions, table
from tallywing.streaming import rollups as R


def in_files(spark, sf_dir, path, parts=4):
    """The events as a folder of several files, oldest first."""
    events = table(spark, sf_dir, "events").orderBy("event_id")
    n = events.count()
    for i in range(parts):
        chunk = events.filter((F.col("event_id") >= n * i // parts) & (F.col("event_id") < n * (i + 1) // parts))
        chunk.coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return str(path)


def test_many_batches_equal_one_table(spark, small, tmp_path):
    folder = in_files(spark, small, tmp_path)
    rolled = R.stream_daily_rollup(R.stream_transactions(spark, folder, files_per_trigger=1))
    got = R.run_available(rolled, ["window_start", "window_end"])
    batch = derive_transactions(table(spark, small, "events"), "arrival").groupBy(F.to_date("timestamp").alias("d")).agg(
        F.count("*").alias("n"), F.sum("amount_inr").alias("s"))
    a = {(str(r.window_start)[:10], r.txn_count, r.total_amount) for r in got.collect()}
    assert a == {(str(r.d), r.n, r.s) for r in batch.collect()}


def shuffled(spark, sf_dir, path, parts=3):
    """The events in files of rows from all over, written in an order of no meaning."""
    events = table(spark, sf_dir, "events").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(parts)))
    for i in range(parts):
        events.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return str(path)


def test_ttl_dedupe_equals_the_batch_form_in_any_order(spark, small, tmp_path):
    folder = shuffled(spark, small, tmp_path)
    for keys, ttl, files in ((["event_type"], 900, 1), (["event_type"], 900, None), (["user_id", "event_type"], 86_400, 1)):
        hits = repeat_hits(table(spark, small, "events"), keys, "ts", ttl)
        want = {r.event_id for r in hits.where("not hit").collect()}
        kept = R.run_ttl_dedupe(R.stream_events(spark, folder, files_per_trigger=files), keys, "event_id", ttl, "60 days")
        assert kept.columns == R.stream_events(spark, folder).columns
        assert {r.event_id for r in kept.collect()} == want
        assert 1 < len(want) < 1000


def test_a_late_row_changes_what_was_kept(spark, tmp_path):
    """Rows at 0 s and 5000 s, then later ones before, between and at the same time, one file after the other."""
    times = [[(1, "a", 5000), (2, "a", 1000), (9, None, 10)], [(3, "a", 60), (4, "a", 4500), (8, None, 10)], [(5, "a", 0), (6, "b", 70), (7, "a", 1900)]]
    for i, rows in enumerate(times):
        df = spark.createDataFrame(rows, "event_id long, user string, s long").select("event_id", "user", F.timestamp_seconds("s").alias(R.EVENT_TIME))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for files in (1, 10):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
        kept = R.run_ttl_dedupe(stream, ["user"], "event_id", 900)
        # 60 s repeats 0 s; 1000 s is 940 s after 60 s; 1900 s repeats 1000 s by exactly the limit; 5000 s repeats 4500 s.
        assert sorted(r.event_id for r in kept.collect()) == [2, 4, 5, 6, 8]


def test_empty_stream(spark, small, tmp_path):
    table(spark, small, "events").filter("false").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stats = R.stream_fraud_stats(R.stream_transactions(spark, str(tmp_path)), "network_type")
    assert R.run_available(stats, ["window_start", "window_end", "network_type"]).isEmpty()


def test_sessions_against_the_built_in_window(spark):
    rng = random.Random(7)
    rows = [(u, t) for u in range(5) for t in rng.sample(range(200_000), 150)]
    df = spark.createDataFrame(rows, "u int, s int").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = R.session_activity(df, "u", gap_seconds=1800)
    # The built-in window closes a session at a pause of exactly the gap; none occurs here by construction.
    want = df.groupBy("u", F.session_window(F.col("ts").cast("timestamp"), "1800 seconds").alias("w")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    assert {(r.u, r.started_at, r.last_activity, r.events) for r in got.collect()} == {
        (r.u, r.a, r.b, r.n) for r in want.collect()}


def test_streamed_sessions_equal_the_batch_form_in_any_order(spark, small, tmp_path):
    folder = shuffled(spark, small, tmp_path)
    for gap, files in ((1800, 1), (86_400, 1), (86_400, None)):
        want = R.session_activity(table(spark, small, "events"), "user_id", gap_seconds=gap)
        got = R.run_sessions(R.stream_events(spark, folder, files_per_trigger=files), "user_id", gap, 60 * 86_400)
        assert got.drop("closed").exceptAll(want).isEmpty() and want.exceptAll(got.drop("closed")).isEmpty()
        assert got.where("closed").isEmpty() or got.where("not closed").count() > 0


def test_a_late_row_joins_two_sessions(spark, tmp_path):
    """a: 0 s and 3000 s are apart until a row at 1500 s comes; b ends with the input; a late row of c is a session of its own."""
    times = [[(1, "a", 0), (2, "a", 3000), (3, "c", 9000)], [(4, "a", 1500), (5, "b", 20_000), (6, None, 100)], [(7, "b", 21_800), (8, "b", 23_601), (9, "c", 50)]]
    for rows in times:
        df = spark.createDataFrame(rows, "event_id long, user string, s long").select("event_id", "user", F.timestamp_seconds("s").alias(R.EVENT_TIME))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seconds = lambda t: t.replace(tzinfo=timezone.utc).timestamp()
    sessions = R.run_sessions(stream, "user", 1800, 20_000 - 100)
    got = {(r.user, seconds(r.started_at), seconds(r.last_activity), r.events, r.closed) for r in sessions.collect()}
    # A pause of exactly the gap does not end a session.
    assert got == {
        ("a", 0, 3000, 3, False), (None, 100, 100, 1, True), ("c", 50, 50, 1, True), ("c", 9000, 9000, 1, False),
        ("b", 20_000, 21_800, 2, False), ("b", 23_601, 23_601, 1, False),
    }


def test_streamed_score_equals_batch(spark, small):
    t = R.stream_transactions(spark, small)
    got = R.run_available(R.stream_rule_score(t).select("transaction_id", "fraud_probability"))
    batch = R.stream_rule_score(derive_transactions(table(spark, small, "events"), "arrival"))
    assert got.exceptAll(batch.select("transaction_id", "fraud_probability")).isEmpty()
    assert got.count() == batch.count()
