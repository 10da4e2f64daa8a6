"""Fraud dashboard, daily rollup and the summary questions of the landing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions import dates as D
from tallywing.operators.aggregates import (
    failed, flag_rate, overall_and_by, share_of_total, value_counts_of,
)
from tallywing.operators.ranking import top
from tallywing.plans.corpus import rows, total_amount
from tallywing.plans.registry import on_transactions

DASHBOARD_DIMENSIONS = ["sender_bank", "day_part", "network_type"]

# Groups round half up; the overall rate rounds half to even.
GROUP_FRAUD_SQL = """count(*) AS total, CAST(sum(fraud_flag) AS BIGINT) AS fraud_count,
       round(sum(fraud_flag) * 100e0 / count(*), 2) AS fraud_rate"""


def fraud_measures(whole: bool = False) -> dict[str, Column]:
    rounding = F.bround if whole else F.round
    return {
        "total": F.count("*"),
        "fraud_count": F.sum("fraud_flag"),
        "fraud_rate": rounding(flag_rate(), 2),
    }


def fraud_by(t: DataFrame, dimension: str) -> DataFrame:
    grouped = t.groupBy(dimension).agg(*[m.alias(n) for n, m in fraud_measures().items()])
    return grouped.orderBy(F.desc("fraud_rate"), dimension)


@on_transactions(
    "d01_overall_fraud",
    """SELECT count(*) AS total, CAST(sum(fraud_flag) AS BIGINT) AS fraud_count,
              round_even(sum(fraud_flag) * 100e0 / count(*), 2) AS fraud_rate FROM transactions""",
)
def d01_overall_fraud(t: DataFrame) -> DataFrame:
    return t.agg(*[m.alias(n) for n, m in fraud_measures(whole=True).items()])


@on_transactions(
    "d02_fraud_by_bank", f"SELECT sender_bank, {GROUP_FRAUD_SQL} FROM transactions GROUP BY 1 ORDER BY 4 DESC"
)
def d02_fraud_by_bank(t: DataFrame) -> DataFrame:
    return fraud_by(t, "sender_bank")


@on_transactions(
    "d03_fraud_by_day_part", f"SELECT day_part, {GROUP_FRAUD_SQL} FROM transactions GROUP BY 1 ORDER BY 4 DESC"
)
def d03_fraud_by_day_part(t: DataFrame) -> DataFrame:
    return fraud_by(t, "day_part")


@on_transactions(
    "d04_fraud_by_network",
    f"SELECT network_type, {GROUP_FRAUD_SQL} FROM transactions GROUP BY 1 ORDER BY 4 DESC",
)
def d04_fraud_by_network(t: DataFrame) -> DataFrame:
    return fraud_by(t, "network_type")


@on_transactions(
    "d05_fraud_dashboard",
    f"""SELECT 'overall' AS dimension, NULL AS key, count(*) AS total,
               CAST(sum(fraud_flag) AS BIGINT) AS fraud_count,
               round_even(sum(fraud_flag) * 100e0 / count(*), 2) AS fraud_rate FROM transactions
        UNION ALL SELECT 'sender_bank', sender_bank, {GROUP_FRAUD_SQL} FROM transactions GROUP BY 2
        UNION ALL SELECT 'day_part', day_part, {GROUP_FRAUD_SQL} FROM transactions GROUP BY 2
        UNION ALL SELECT 'network_type', network_type, {GROUP_FRAUD_SQL} FROM transactions GROUP BY 2""",
)
def d05_fraud_dashboard(t: DataFrame) -> DataFrame:
    """d01 to d04 from one scan; rows are told apart by `dimension`.

    The scan is first reduced to one row per combination of the three dimensions, so
    that only these are repeated for the four groupings.
    """
    combos = t.groupBy(*DASHBOARD_DIMENSIONS).agg(rows("total"), F.sum("fraud_flag").alias("fraud_count"))
    measures = {"total": F.sum("total"), "fraud_count": F.sum("fraud_count")}
    every = overall_and_by(combos, DASHBOARD_DIMENSIONS, measures).withColumn(
        "fraud_rate", F.try_divide(F.col("fraud_count") * F.lit(100.0), F.col("total"))
    )
    rounded = F.when(F.col("dimension") == "overall", F.bround("fraud_rate", 2)).otherwise(
        F.round("fraud_rate", 2)
    )
    return every.withColumn("fraud_rate", rounded)


def daily_rollup(t: DataFrame) -> DataFrame:
    return t.groupBy(F.to_date("timestamp").alias("date")).agg(
        rows("txn_count"),
        total_amount(),
        F.count_if(failed()).alias("failed_count"),
        F.sum("fraud_flag").alias("fraud_count"),
    )


@on_transactions(
    "d06_daily_rollup",
    """SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, count(*) AS txn_count,
              CAST(sum(amount_inr) AS BIGINT) AS total_amount,
              count(*) FILTER (WHERE transaction_status = 'FAILED') AS failed_count,
              CAST(sum(fraud_flag) AS BIGINT) AS fraud_count FROM transactions GROUP BY 1 ORDER BY 1""",
)
def d06_daily_rollup(t: DataFrame) -> DataFrame:
    return daily_rollup(t).withColumn("date", F.col("date").cast("string")).orderBy("date")


@on_transactions(
    "d07_network_distribution",
    """SELECT network_type, count(*) AS count, count(*) * 100e0 / sum(count(*)) OVER () AS percentage
       FROM transactions GROUP BY 1""",
)
def d07_network_distribution(t: DataFrame) -> DataFrame:
    return share_of_total(t.groupBy("network_type").agg(rows()), "count")


@on_transactions(
    "d08_last_7_days",
    """SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, count(*) AS txn_count FROM transactions
       WHERE "timestamp" > (SELECT max("timestamp") FROM transactions) - INTERVAL 7 DAY
       GROUP BY 1 ORDER BY 1""",
)
def d08_last_7_days(t: DataFrame, days: int = 7) -> DataFrame:
    latest = t.agg(F.max("timestamp")).scalar()
    recent = t.filter(F.col("timestamp") > latest - F.make_dt_interval(F.lit(days)))
    per_day = recent.groupBy(F.to_date("timestamp").alias("date")).agg(rows("txn_count"))
    return per_day.withColumn("date", F.col("date").cast("string")).orderBy("date")


@on_transactions(
    "d09_top5_states",
    "SELECT sender_state, count(*) AS txn_count FROM transactions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    state=True,
)
def d09_top5_states(t: DataFrame, n: int = 5) -> DataFrame:
    return top(t.groupBy("sender_state").agg(rows("txn_count")), n, F.desc("txn_count"), "sender_state")


@on_transactions("d10_total_amount", "SELECT CAST(sum(amount_inr) AS BIGINT) AS total_amount FROM transactions")
def d10_total_amount(t: DataFrame) -> DataFrame:
    return t.agg(total_amount())


@on_transactions(
    "d11_july_adult_weekend_top5",
    """SELECT transaction_id, amount_inr FROM transactions
       WHERE month("timestamp") = 7 AND sender_age_label = 'Adult' AND is_weekend = 1
       ORDER BY amount_inr DESC, transaction_id LIMIT 5""",
)
def d11_july_adult_weekend_top5(t: DataFrame, month: int = 7, label: str = "Adult", n: int = 5) -> DataFrame:
    hits = t.filter(
        (F.month("timestamp") == month) & (F.col("sender_age_label") == label) & (F.col("is_weekend") == 1)
    )
    return top(hits.select("transaction_id", "amount_inr"), n, F.desc("amount_inr"), "transaction_id")


@on_transactions(
    "d12_top5_by_amount",
    """SELECT transaction_id, amount_inr, transaction_type, sender_bank FROM transactions
       ORDER BY amount_inr DESC, transaction_id LIMIT 5""",
)
def d12_top5_by_amount(t: DataFrame, n: int = 5) -> DataFrame:
    return top(
        t.select("transaction_id", "amount_inr", "transaction_type", "sender_bank"),
        n, F.desc("amount_inr"), "transaction_id",
    )


@on_transactions(
    "d13_top_bank_count",
    "SELECT sender_bank, count(*) AS txn_count FROM transactions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
def d13_top_bank_count(t: DataFrame) -> DataFrame:
    return top(t.groupBy("sender_bank").agg(rows("txn_count")), 1, F.desc("txn_count"), "sender_bank")


@on_transactions(
    "d14_volume_by_bank",
    """SELECT sender_bank, count(*) AS txn_count, CAST(sum(amount_inr) AS BIGINT) AS total_amount
       FROM transactions GROUP BY 1""",
)
def d14_volume_by_bank(t: DataFrame) -> DataFrame:
    return t.groupBy("sender_bank").agg(rows("txn_count"), total_amount())


@on_transactions(
    "d15_feature_distributions",
    """SELECT "column", "value", count(*) AS count
       FROM (SELECT day_part, amount_tier, sender_age_label, receiver_age_label FROM transactions)
       UNPIVOT ("value" FOR "column" IN (day_part, amount_tier, sender_age_label, receiver_age_label))
       GROUP BY 1, 2""",
)
def d15_feature_distributions(t: DataFrame) -> DataFrame:
    return value_counts_of(t, ["day_part", "amount_tier", "sender_age_label", "receiver_age_label"])


@on_transactions(
    "d16_monthly_category_spend",
    """SELECT strftime("timestamp", '%Y-%m') AS month, CAST(sum(amount_inr) AS BIGINT) AS total_amount
       FROM transactions WHERE merchant_category = 'Food' GROUP BY 1 ORDER BY 1""",
)
def d16_monthly_category_spend(t: DataFrame, category: str = "Food") -> DataFrame:
    spent = t.filter(F.col("merchant_category") == category)
    by_month = spent.groupBy(F.trunc("timestamp", "MM").alias("m")).agg(total_amount())
    return by_month.select(D.year_month(F.col("m")).alias("month"), "total_amount").orderBy("month")
