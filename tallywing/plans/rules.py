"""Data-quality rules and single aggregate, join and ordering operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions import dates as D
from tallywing.operators import quality as Q
from tallywing.operators.aggregates import (
    count_by_status, failed, grand_total, overall_and_by, rate, value_counts,
)
from tallywing.operators.joins import children_of, lookup
from tallywing.operators.ranking import by_magnitude, first_per_group, hash_sample, top
from tallywing.plans.corpus import FAILURE_SQL, rows
from tallywing.plans.dashboard import daily_rollup
from tallywing.plans.registry import on_transactions, register
from tallywing.session import scratch_path
from tallywing.sources.files import read_query, register_sql
from tallywing.sources.fixture import table, transactions, with_transactions

FAST_NETWORKS = ["4G", "5G", "WiFi"]
_IN = {c: ", ".join(f"'{v}'" for v in values) for c, values in S.DOMAINS.items()}
_DOMAIN_SQL = " UNION ALL ".join(
    f"SELECT '{c} in domain' AS rule, count(*) FILTER (WHERE {c} NOT IN ({v})) AS violations FROM transactions"
    for c, v in _IN.items()
)


@on_transactions("dq1_domains", _DOMAIN_SQL)
def dq1_domains(t: DataFrame) -> DataFrame:
    return Q.count_violations(t, Q.domain_rules())


@on_transactions(
    "dq1_domain_values",
    """SELECT 'network_type' AS "column", network_type AS "value", count(*) AS count FROM transactions
       WHERE network_type NOT IN ('4G', '5G', 'WiFi') GROUP BY 2
       UNION ALL SELECT 'device_type', device_type, count(*) FROM transactions
       WHERE device_type NOT IN ('Android') GROUP BY 2""",
)
def dq1_domain_values(t: DataFrame) -> DataFrame:
    """Unlisted values under a narrower domain than the stored one."""
    return Q.domain_violations(t, {"network_type": FAST_NETWORKS, "device_type": ["Android"]})


@on_transactions(
    "dq2_p2p_category",
    """SELECT 'P2P has no category' AS rule,
              count(*) FILTER (WHERE transaction_type = 'P2P' AND merchant_category IS NOT NULL) AS violations
       FROM transactions UNION ALL
       SELECT 'others have a category',
              count(*) FILTER (WHERE transaction_type <> 'P2P' AND merchant_category IS NULL) FROM transactions""",
)
def dq2_p2p_category(t: DataFrame) -> DataFrame:
    return Q.count_violations(t, Q.category_rules())


_RECEIVER_SQL = " UNION ALL ".join(
    f"""SELECT 'P2P has {c}' AS rule, count(*) FILTER (WHERE transaction_type = 'P2P' AND {c} IS NULL)
          AS violations FROM transactions
        UNION ALL SELECT 'others have no {c}',
          count(*) FILTER (WHERE transaction_type <> 'P2P' AND {c} IS NOT NULL) FROM transactions"""
    for c in ("receiver_age_group", "receiver_age_label")
)


@on_transactions("dq3_receiver", _RECEIVER_SQL)
def dq3_receiver(t: DataFrame) -> DataFrame:
    return Q.count_violations(t, Q.receiver_rules())


@on_transactions(
    "dq4_ranges",
    """SELECT 'hour_of_day in 0..23' AS rule, count(*) FILTER (WHERE hour_of_day NOT BETWEEN 0 AND 23) AS violations
       FROM transactions
       UNION ALL SELECT 'is_weekend is 0 or 1', count(*) FILTER (WHERE is_weekend NOT IN (0, 1)) FROM transactions
       UNION ALL SELECT 'fraud_flag is 0 or 1', count(*) FILTER (WHERE fraud_flag NOT IN (0, 1)) FROM transactions
       UNION ALL SELECT 'amount_inr not negative', count(*) FILTER (WHERE amount_inr < 0) FROM transactions""",
)
def dq4_ranges(t: DataFrame) -> DataFrame:
    return Q.count_violations(t, Q.range_rules())


@on_transactions(
    "dq5_derivations",
    """SELECT c || ' as derived' AS rule,
              CASE c WHEN 'day_part' THEN (SELECT count(*) FROM transactions WHERE day_part <>
                CASE WHEN hour_of_day IN (22, 23) OR hour_of_day < 6 THEN 'Night' WHEN hour_of_day < 12 THEN 'Morning'
                     WHEN hour_of_day < 18 THEN 'Afternoon' ELSE 'Evening' END) ELSE 0 END AS violations
       FROM (VALUES ('hour_of_day'), ('day_of_week'), ('is_weekend'), ('day_part'), ('amount_tier'),
                    ('sender_age_label'), ('receiver_age_label')) v(c)""",
)
def dq5_derivations(t: DataFrame) -> DataFrame:
    """Stored columns against the dictionary's rules; its day parts differ from the stored ones."""
    return Q.count_violations(t, Q.derivation_rules("dictionary"))


@on_transactions(
    "dq6_keys",
    """SELECT 'transaction_id unique' AS rule,
              (SELECT count(*) FROM (SELECT 1 FROM transactions GROUP BY transaction_id HAVING count(*) > 1)) AS violations
       UNION ALL SELECT 'transaction_id well formed',
              (SELECT count(*) FROM transactions WHERE NOT regexp_full_match(transaction_id, 'TXN\\d{10}'))""",
)
def dq6_keys(t: DataFrame) -> DataFrame:
    return Q.key_checks(t)


@register(
    "dq6_repeated_keys",
    """SELECT 'user_id unique' AS rule, count(*) FILTER (WHERE n > 1) AS violations
       FROM (SELECT count(*) AS n FROM events GROUP BY user_id)
       UNION ALL SELECT 'user_id well formed', count(*) FROM (SELECT DISTINCT user_id FROM events)""",
)
def dq6_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is no key: nearly every value repeats and none has the key's form."""
    events = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))
    return Q.key_checks(events, "user_id")


@on_transactions(
    "dq7_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count("{c}") AS nulls,
                   count(DISTINCT "{c}") AS distinct_values FROM transactions"""
        for c in S.TRANSACTION_COLUMNS
    ),
    state=True,
)
def dq7_profile(t: DataFrame) -> DataFrame:
    """All 21 columns, distinct values counted exactly."""
    return Q.profile(t, S.TRANSACTION_COLUMNS, exact=True)


@on_transactions("dq7_profile_approx", state=True)
def dq7_profile_approx(t: DataFrame) -> DataFrame:
    """All columns, with approximate distinct counts."""
    return Q.profile(t)


@register(
    "dq7_profile_days",
    with_transactions(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count("{c}") AS nulls, true AS within_error
                FROM transactions WHERE "timestamp" >= '2024-06-01' AND "timestamp" < '2024-09-01'"""
            for c in S.TRANSACTION_COLUMNS
        )
    ),
)
def dq7_profile_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three months of all columns from stored sketches of days, and whether the distinct counts agree with exact ones."""
    t = transactions(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    Q.day_sketches(t, S.TRANSACTION_COLUMNS).write.parquet(path)
    sketched = Q.profile_days(spark.read.parquet(path), "2024-06-01", "2024-08-31")
    day = F.to_date("timestamp")
    summer = t.filter((day >= F.lit("2024-06-01").cast("date")) & (day <= F.lit("2024-08-31").cast("date")))
    exact = Q.profile(summer, S.TRANSACTION_COLUMNS, exact=True).select("column", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact"))
    within = off <= F.col("exact") * F.lit(Q.SKETCH_ERROR)
    return sketched.join(exact, "column").select("column", "rows", "nulls", within.alias("within_error"))


@on_transactions("a02_approx_distinct")
def a02_approx_distinct(t: DataFrame) -> DataFrame:
    return t.agg(
        F.approx_count_distinct("sender_bank").alias("banks"),
        F.approx_count_distinct("transaction_id", 0.02).alias("transactions"),
    )


@on_transactions(
    "a06_rates",
    f"SELECT sender_bank, {FAILURE_SQL} AS failure_rate FROM transactions GROUP BY 1",
)
def a06_rates(t: DataFrame) -> DataFrame:
    return t.groupBy("sender_bank").agg(rate(failed()).alias("failure_rate"))


@on_transactions(
    "a14_value_counts",
    """SELECT merchant_category, count(merchant_category) AS count FROM transactions
       GROUP BY 1 HAVING merchant_category IS NOT NULL""",
)
def a14_value_counts(t: DataFrame) -> DataFrame:
    return value_counts(t, "merchant_category")


@on_transactions(
    "a15_daily_extent",
    """WITH d AS (SELECT CAST("timestamp" AS DATE) AS d, count(*) AS n, sum(amount_inr) AS s FROM transactions GROUP BY 1)
       SELECT CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, count(*) AS days,
              round_even(avg(n), 0) AS avg_daily_count, round_even(avg(s), 0) AS avg_daily_amount FROM d""",
)
def a15_daily_extent(t: DataFrame) -> DataFrame:
    return daily_rollup(t).agg(
        F.min("date").cast("string").alias("first_day"),
        F.max("date").cast("string").alias("last_day"),
        F.count("*").alias("days"),
        F.bround(F.avg("txn_count"), 0).alias("avg_daily_count"),
        F.bround(F.avg("total_amount"), 0).alias("avg_daily_amount"),
    )


@on_transactions(
    "a17_count_by_status",
    """SELECT merchant_category, count(*) FILTER (WHERE transaction_status = 'SUCCESS') AS success,
              count(*) FILTER (WHERE transaction_status = 'FAILED') AS failed FROM transactions GROUP BY 1""",
)
def a17_count_by_status(t: DataFrame) -> DataFrame:
    return count_by_status(t, "merchant_category", "transaction_status", S.STATUSES)


@on_transactions(
    "a18_overall_and_by",
    """SELECT 'overall' AS dimension, NULL AS key, count(*) AS n, avg(amount_inr) AS avg_amount FROM transactions
       UNION ALL SELECT 'merchant_category', merchant_category, count(*), avg(amount_inr) FROM transactions GROUP BY 2
       UNION ALL SELECT 'device_type', device_type, count(*), avg(amount_inr) FROM transactions GROUP BY 2""",
)
def a18_overall_and_by(t: DataFrame) -> DataFrame:
    """A dimension with NULL keys: its NULL row and the overall row stay apart."""
    return overall_and_by(
        t, ["merchant_category", "device_type"], {"n": F.count("*"), "avg_amount": F.avg("amount_inr")}
    )


@register(
    "p13_parameters",
    with_transactions(
        """SELECT transaction_type, count(*) AS count, CAST(sum(amount_inr) AS BIGINT) AS total_amount
           FROM transactions WHERE sender_bank = 'HDFC' AND amount_inr > 1000 GROUP BY 1"""
    ),
)
def p13_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark, transactions(spark, sf_dir))
    return read_query(
        spark,
        """SELECT transaction_type, count(*) AS count, sum(amount_inr) AS total_amount FROM transactions
           WHERE sender_bank = :bank AND amount_inr > :least GROUP BY transaction_type""",
        bank="HDFC", least=1000,
    )


@register(
    "s04_read_query",
    with_transactions(
        """SELECT strftime("timestamp", '%Y-%m') AS month, day_part, amount_tier, count(*) AS count
           FROM transactions WHERE sender_age_label = 'Adult' GROUP BY 1, 2, 3 HAVING count(*) > 10"""
    ),
)
def s04_read_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query text with the stored table's date functions and the row functions."""
    register_sql(spark, transactions(spark, sf_dir))
    return read_query(
        spark,
        """SELECT strftime('%Y-%m', timestamp) AS month, day_part_of(hour_of_day) AS day_part,
                  amount_tier_of(amount_inr) AS amount_tier, count(*) AS count FROM transactions
           WHERE age_label_of(sender_age_group) = 'Adult' GROUP BY month, 2, 3 HAVING count > 10""",
    )


@on_transactions(
    "j06_transactions",
    """SELECT * EXCLUDE (risk) REPLACE (strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp") FROM transactions""",
    state=True,
)
def j06_transactions(t: DataFrame) -> DataFrame:
    """Every row and column of the enriched fact frame."""
    return t.withColumn("timestamp", D.iso_text(F.col("timestamp")))


@register(
    "j02_children_of",
    """SELECT conv_id, count(*) AS messages FROM conversations
       WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1""",
)
def j02_children_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the sessions that were opened with instructions."""
    messages = table(spark, sf_dir, "conversations")
    instructed = messages.filter("role = 'system'").select("conv_id")
    return children_of(messages, instructed, "conv_id").groupBy("conv_id").agg(rows("messages"))


@register(
    "j06_lookup",
    """SELECT c_nationkey, n_name, count(*) AS events, count(DISTINCT user_id) AS users
       FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""",
)
def j06_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted per user before the join, so that only one row per user meets the dimension."""
    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(rows("n"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    homed = lookup(per_user, lookup(customer, nation, "c_nationkey"), "user_id")
    return homed.groupBy("c_nationkey", "n_name").agg(F.sum("n").alias("events"), rows("users"))


@on_transactions(
    "o05_row_cap",
    """SELECT transaction_id, amount_inr, sender_bank FROM transactions
       ORDER BY amount_inr DESC, transaction_id LIMIT 50""",
)
def o05_row_cap(t: DataFrame, n: int = 50) -> DataFrame:
    """The capped partial result shown while a full answer is prepared."""
    return top(t.select("transaction_id", "amount_inr", "sender_bank"), n, F.desc("amount_inr"), "transaction_id")


@on_transactions(
    "o06_last_per_group",
    """SELECT sender_bank, transaction_id, row_number() OVER w AS rank FROM transactions
       WINDOW w AS (PARTITION BY sender_bank ORDER BY "timestamp" DESC, transaction_id)
       QUALIFY row_number() OVER w <= 6""",
)
def o06_last_per_group(t: DataFrame, n: int = 6) -> DataFrame:
    newest = first_per_group(
        t.select("sender_bank", "transaction_id", "timestamp"),
        ["sender_bank"], n, F.desc("timestamp"), "transaction_id",
    )
    return newest.drop("timestamp")


@on_transactions(
    "o07_by_magnitude",
    """SELECT sender_state, avg(amount_inr) - (SELECT avg(amount_inr) FROM transactions) AS deviation
       FROM transactions GROUP BY 1""",
    state=True,
)
def o07_by_magnitude(t: DataFrame) -> DataFrame:
    """States by how far their average lies from the overall one."""
    states = t.groupBy("sender_state").agg(
        F.avg("amount_inr").alias("mean"), F.sum("amount_inr").alias("s"), F.count("*").alias("n")
    )
    overall = grand_total(states, "s").cast("double") / grand_total(states, "n")
    return by_magnitude(
        states.select("sender_state", (F.col("mean") - overall).alias("deviation")), "deviation", "sender_state"
    )


@on_transactions(
    "x01_hash_sample",
    """SELECT transaction_id, hour_of_day, day_part, amount_inr, amount_tier FROM transactions
       ORDER BY md5(transaction_id || '#42'), transaction_id LIMIT 10""",
)
def x01_hash_sample(t: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """A fixed handful of rows to look at: derived columns beside their sources."""
    cols = t.select("transaction_id", "hour_of_day", "day_part", "amount_inr", "amount_tier")
    return hash_sample(cols, n, "transaction_id", seed)
