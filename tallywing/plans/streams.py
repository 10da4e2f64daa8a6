"""Streaming operators, run over all events in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.operators import fraud_model as M
from tallywing.plans.corpus import rows
from tallywing.plans.models import trained_model
from tallywing.plans.registry import register
from tallywing.sources.fixture import home_states, table, with_transactions
from tallywing.streaming import rollups as R


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Window bounds as `yyyy-MM-dd HH:mm:ss` in UTC."""
    return df.withColumns({c: F.substring(F.col(c).cast("timestamp_ntz").cast("string"), 1, 19) for c in columns})


@register(
    "st01_stream_daily_rollup",
    with_transactions(
        """SELECT strftime(date_trunc('day', "timestamp"), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS txn_count,
                  CAST(sum(amount_inr) AS BIGINT) AS total_amount,
                  count(*) FILTER (WHERE transaction_status = 'FAILED') AS failed_count,
                  CAST(sum(fraud_flag) AS BIGINT) AS fraud_count FROM transactions GROUP BY 1""",
        "arrival",
    ),
)
def st01_stream_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = R.stream_daily_rollup(R.stream_transactions(spark, sf_dir))
    done = R.run_available(rolled, ["window_start", "window_end"])
    return as_text(done.drop("window_end"), "window_start")


@register(
    "st02_stream_fraud_stats",
    with_transactions(
        """SELECT strftime(date_trunc('day', "timestamp"), '%Y-%m-%d %H:%M:%S') AS window_start, network_type,
                  count(*) AS total, CAST(sum(fraud_flag) AS BIGINT) AS fraud_count,
                  round(sum(fraud_flag) * 100e0 / count(*), 2) AS fraud_rate FROM transactions GROUP BY 1, 2""",
        "arrival",
    ),
)
def st02_stream_fraud_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = R.stream_fraud_stats(R.stream_transactions(spark, sf_dir), "network_type")
    done = R.run_available(stats, ["window_start", "window_end", "network_type"])
    return as_text(done.drop("window_end"), "window_start")


@register(
    "st02_stream_fraud_sliding",
    with_transactions(
        """SELECT strftime(date_trunc('hour', "timestamp")
                           - to_hours(CAST((hour("timestamp") % 6) AS INTEGER)) - to_hours(CAST(6 * i AS INTEGER)),
                           '%Y-%m-%d %H:%M:%S') AS window_start,
                  sender_bank, count(*) AS total, CAST(sum(fraud_flag) AS BIGINT) AS fraud_count,
                  round(sum(fraud_flag) * 100e0 / count(*), 2) AS fraud_rate
           FROM transactions, range(0, 4) r(i) GROUP BY 1, 2""",
        "arrival",
    ),
)
def st02_stream_fraud_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that start every six hours."""
    stats = R.stream_fraud_stats(R.stream_transactions(spark, sf_dir), "sender_bank", "1 day", "6 hours")
    done = R.run_available(stats, ["window_start", "window_end", "sender_bank"])
    return as_text(done.drop("window_end"), "window_start")


@register(
    "st03_stream_ttl_dedupe",
    """SELECT event_type, count(*) AS kept
       FROM (SELECT event_type, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events)
       WHERE gap IS NULL OR gap > INTERVAL 15 MINUTE GROUP BY 1""",
)
def st03_stream_ttl_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.run_ttl_dedupe(R.stream_events(spark, sf_dir), ["user_id", "event_type"], "event_id")
    return kept.groupBy("event_type").agg(rows("kept"))


@register(
    "st03_stream_slot_dedupe",
    """SELECT event_type, count(DISTINCT (user_id, time_bucket(INTERVAL 15 MINUTE, ts))) AS kept
       FROM events GROUP BY 1""",
)
def st03_stream_slot_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.stream_slot_dedupe(R.stream_events(spark, sf_dir), ["user_id", "event_type"])
    return R.run_available(kept).groupBy("event_type").agg(rows("kept"))


@register(
    "st04_stream_score",
    with_transactions(
        """SELECT transaction_id, round(risk / 300e0, 4) AS fraud_probability,
                  CASE WHEN risk >= 210 THEN 'High' WHEN risk >= 90 THEN 'Medium' ELSE 'Low' END AS risk_level,
                  if(risk >= 150, 'FRAUD', 'LEGITIMATE') AS prediction FROM transactions""",
        "arrival",
    ),
)
def st04_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.stream_rule_score(R.stream_transactions(spark, sf_dir))
    return R.run_available(scored.select("transaction_id", "fraud_probability", "risk_level", "prediction"))


@register("st04_stream_score_model")
def st04_stream_score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving transactions scored by the trained model, with the state that the user table gives them."""
    model = trained_model(spark, sf_dir)
    arriving = R.stream_transactions(spark, sf_dir).join(home_states(spark, sf_dir), "user_id", "left")
    scored = M.score(model, arriving.select("transaction_id", *S.FEATURE_COLUMNS))
    return R.run_available(scored.select("transaction_id", "fraud_probability", "risk_level", "prediction"))


SESSIONS_SQL = """SELECT user_id, session, min(ts) AS started_at, max(ts) AS last_activity, count(*) AS events
  FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS session
        FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000,
                                 true) AS new FROM events)) GROUP BY 1, 2"""


@register(
    "st05_session_activity",
    f"""SELECT user_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
               strftime(last_activity, '%Y-%m-%d %H:%M:%S') AS last_activity, events FROM ({SESSIONS_SQL})""",
)
def st05_session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = R.session_activity(table(spark, sf_dir, "events"), "user_id")
    return as_text(sessions.drop("session"), "started_at", "last_activity")


@register(
    "st05_stream_sessions",
    f"""SELECT user_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS window_start, events FROM ({SESSIONS_SQL})
        WHERE last_activity + INTERVAL 30 MINUTE
              <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""",
)
def st05_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by the end of the input; those still open are not reported yet."""
    done = R.run_available(R.stream_sessions(R.stream_events(spark, sf_dir), "user_id"))
    return as_text(done.drop("window_end"), "window_start")


@register(
    "st05_stream_all_sessions",
    f"""SELECT user_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
               strftime(last_activity, '%Y-%m-%d %H:%M:%S') AS last_activity, events,
               last_activity + INTERVAL 90 MINUTE < (SELECT max(ts) FROM events) AS closed FROM ({SESSIONS_SQL})""",
)
def st05_stream_all_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed and open sessions at the end of the input."""
    sessions = R.run_sessions(R.stream_events(spark, sf_dir), "user_id")
    return as_text(sessions.drop("session"), "started_at", "last_activity")
