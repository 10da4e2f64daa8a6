"""The thirty benchmark questions, as functions of the transaction frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions import dates as D
from tallywing.operators.aggregates import failed, flag_rate, rate, succeeded
from tallywing.operators.ranking import top
from tallywing.plans.corpus import FAILURE_SQL, FRAUD_SQL, SUCCESS_SQL, rows, total_amount
from tallywing.plans.registry import on_transactions

# The category each question counts towards on the scoreboard.
CATEGORIES = {
    "Basic": ["t01_total", "t02_success_amount", "t03_distinct_banks"],
    "Filtering": ["t04_ios_count", "t05_avg_failed", "t06_weekday_fraud"],
    "GroupBy": ["t07_by_device", "t08_bank_amount", "t09_by_type"],
    "DateTime": ["t10_march", "t11_monthly_amount", "t12_top_dow"],
    "Percentage": ["t13_fraud_rate", "t14_success_by_network", "t15_p2p_pct"],
    "MultiCondition": ["t16_large_p2p_success", "t17_failed_recharge_wifi", "t18_karnataka_fraud_avg"],
    "Having": ["t19_busy_categories", "t20_banks_high_failure"],
    "CrossColumn": ["t21_fraud_by_age", "t22_state_by_type"],
    "Ranking": ["t23_top_state", "t24_top_banks_avg", "t25_rare_categories"],
    "NullHandling": ["t26_null_category"],
    "Novel": ["t27_avg_by_tier", "t28_failure_by_hour", "t29_p2p_p2m_ratio", "t30_summary"],
}


@on_transactions("t01_total", "SELECT count(*) AS total FROM transactions")
def t01_total(t: DataFrame) -> DataFrame:
    return t.agg(rows("total"))


@on_transactions(
    "t02_success_amount",
    "SELECT CAST(sum(amount_inr) FILTER (WHERE transaction_status = 'SUCCESS') AS BIGINT) AS total FROM transactions",
)
def t02_success_amount(t: DataFrame) -> DataFrame:
    return t.filter(succeeded()).agg(total_amount("total"))


@on_transactions("t03_distinct_banks", "SELECT count(DISTINCT sender_bank) AS bank_count FROM transactions")
def t03_distinct_banks(t: DataFrame) -> DataFrame:
    return t.agg(F.count_distinct("sender_bank").alias("bank_count"))


@on_transactions(
    "t04_ios_count", "SELECT count(*) FILTER (WHERE device_type = 'iOS') AS ios_count FROM transactions"
)
def t04_ios_count(t: DataFrame, device: str = "iOS") -> DataFrame:
    return t.filter(F.col("device_type") == device).agg(rows("ios_count"))


@on_transactions(
    "t05_avg_failed",
    "SELECT avg(amount_inr) FILTER (WHERE transaction_status = 'FAILED') AS avg_failed FROM transactions",
)
def t05_avg_failed(t: DataFrame) -> DataFrame:
    return t.filter(failed()).agg(F.avg("amount_inr").alias("avg_failed"))


@on_transactions(
    "t06_weekday_fraud",
    "SELECT count(*) FILTER (WHERE fraud_flag = 1 AND is_weekend = 0) AS count FROM transactions",
)
def t06_weekday_fraud(t: DataFrame) -> DataFrame:
    return t.filter((F.col("fraud_flag") == 1) & (F.col("is_weekend") == 0)).agg(rows())


@on_transactions("t07_by_device", "SELECT device_type, count(*) AS count FROM transactions GROUP BY ALL")
def t07_by_device(t: DataFrame) -> DataFrame:
    return t.groupBy("device_type").agg(rows())


@on_transactions(
    "t08_bank_amount",
    """SELECT sender_bank, CAST(sum(amount_inr) AS BIGINT) AS total FROM transactions
       GROUP BY ALL ORDER BY 2 DESC""",
)
def t08_bank_amount(t: DataFrame) -> DataFrame:
    return t.groupBy("sender_bank").agg(total_amount("total")).orderBy(F.desc("total"), "sender_bank")


@on_transactions("t09_by_type", "SELECT transaction_type, count(*) AS count FROM transactions GROUP BY ALL")
def t09_by_type(t: DataFrame) -> DataFrame:
    return t.groupBy("transaction_type").agg(rows())


@on_transactions(
    "t10_march", """SELECT count(*) FILTER (WHERE month("timestamp") = 3) AS count FROM transactions"""
)
def t10_march(t: DataFrame, month: int = 3) -> DataFrame:
    return t.filter(F.month("timestamp") == month).agg(rows())


@on_transactions(
    "t11_monthly_amount",
    """SELECT strftime("timestamp", '%Y-%m') AS month, CAST(sum(amount_inr) AS BIGINT) AS total
       FROM transactions GROUP BY ALL ORDER BY 1""",
)
def t11_monthly_amount(t: DataFrame) -> DataFrame:
    by_month = t.groupBy(F.trunc("timestamp", "MM").alias("m")).agg(total_amount("total"))
    return by_month.select(D.year_month(F.col("m")).alias("month"), "total").orderBy("month")


@on_transactions(
    "t12_top_dow",
    "SELECT day_of_week, count(*) AS count FROM transactions GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1",
)
def t12_top_dow(t: DataFrame) -> DataFrame:
    return top(t.groupBy("day_of_week").agg(rows()), 1, F.desc("count"), "day_of_week")


@on_transactions("t13_fraud_rate", f"SELECT {FRAUD_SQL} AS fraud_rate FROM transactions")
def t13_fraud_rate(t: DataFrame) -> DataFrame:
    return t.agg(flag_rate().alias("fraud_rate"))


@on_transactions(
    "t14_success_by_network",
    f"SELECT network_type, {SUCCESS_SQL} AS success_rate FROM transactions GROUP BY ALL",
)
def t14_success_by_network(t: DataFrame) -> DataFrame:
    return t.groupBy("network_type").agg(rate(succeeded()).alias("success_rate"))


@on_transactions(
    "t15_p2p_pct",
    """SELECT count(*) FILTER (WHERE transaction_type = 'P2P') * 100e0 / count(*) AS p2p_pct
       FROM transactions""",
)
def t15_p2p_pct(t: DataFrame, kind: str = "P2P") -> DataFrame:
    # Part and whole come from the same scan.
    return t.agg(rate(F.col("transaction_type") == kind).alias("p2p_pct"))


@on_transactions(
    "t16_large_p2p_success",
    """SELECT count(*) AS count FROM transactions
       WHERE (transaction_type, amount_tier, transaction_status) = ('P2P', 'Large', 'SUCCESS')""",
)
def t16_large_p2p_success(t: DataFrame, tier: str = "Large") -> DataFrame:
    hits = t.filter((F.col("transaction_type") == "P2P") & (F.col("amount_tier") == tier) & succeeded())
    return hits.agg(rows())


@on_transactions(
    "t17_failed_recharge_wifi",
    """SELECT transaction_id, amount_inr, sender_bank FROM transactions
       WHERE (transaction_type, transaction_status, network_type) = ('Recharge', 'FAILED', 'WiFi')""",
)
def t17_failed_recharge_wifi(t: DataFrame) -> DataFrame:
    hits = t.filter((F.col("transaction_type") == "Recharge") & failed() & (F.col("network_type") == "WiFi"))
    return hits.select("transaction_id", "amount_inr", "sender_bank")


@on_transactions(
    "t18_karnataka_fraud_avg",
    """SELECT avg(amount_inr) AS avg_amount FROM transactions
       WHERE (fraud_flag, sender_state, network_type) = (1, 'Karnataka', '4G')""",
    state=True,
)
def t18_karnataka_fraud_avg(t: DataFrame, state: str = "Karnataka", network: str = "4G") -> DataFrame:
    hits = t.filter(
        (F.col("fraud_flag") == 1) & (F.col("sender_state") == state) & (F.col("network_type") == network)
    )
    return hits.agg(F.avg("amount_inr").alias("avg_amount"))


@on_transactions(
    "t19_busy_categories",
    """SELECT merchant_category, count(*) AS count FROM transactions
       WHERE merchant_category IS NOT NULL GROUP BY ALL HAVING count(*) > 640""",
    threshold=640,
)
def t19_busy_categories(t: DataFrame, threshold: int = 5000) -> DataFrame:
    counts = t.filter("merchant_category IS NOT NULL").groupBy("merchant_category").agg(rows())
    return counts.filter(F.col("count") > threshold)


@on_transactions(
    "t20_banks_high_failure",
    f"""SELECT sender_bank, {FAILURE_SQL} AS failure_rate FROM transactions
        GROUP BY ALL HAVING {FAILURE_SQL} > 10""",
)
def t20_banks_high_failure(t: DataFrame, threshold: float = 10.0) -> DataFrame:
    banks = t.groupBy("sender_bank").agg(rate(failed()).alias("failure_rate"))
    return banks.filter(F.col("failure_rate") > threshold)


@on_transactions(
    "t21_fraud_by_age", f"SELECT sender_age_label, {FRAUD_SQL} AS fraud_rate FROM transactions GROUP BY ALL"
)
def t21_fraud_by_age(t: DataFrame) -> DataFrame:
    return t.groupBy("sender_age_label").agg(flag_rate().alias("fraud_rate"))


@on_transactions(
    "t22_state_by_type",
    """SELECT sender_state, transaction_type, count(*) AS count FROM transactions
       GROUP BY ALL ORDER BY 1, 3 DESC""",
    state=True,
)
def t22_state_by_type(t: DataFrame) -> DataFrame:
    pairs = t.groupBy("sender_state", "transaction_type").agg(rows())
    return pairs.orderBy("sender_state", F.desc("count"), "transaction_type")


@on_transactions(
    "t23_top_state",
    "SELECT sender_state, count(*) AS count FROM transactions GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1",
    state=True,
)
def t23_top_state(t: DataFrame) -> DataFrame:
    return top(t.groupBy("sender_state").agg(rows()), 1, F.desc("count"), "sender_state")


@on_transactions(
    "t24_top_banks_avg",
    """SELECT sender_bank, avg(amount_inr) AS avg_amount FROM transactions
       GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5""",
)
def t24_top_banks_avg(t: DataFrame, n: int = 5) -> DataFrame:
    banks = t.groupBy("sender_bank").agg(F.avg("amount_inr").alias("avg_amount"))
    return top(banks, n, F.desc("avg_amount"), "sender_bank")


@on_transactions(
    "t25_rare_categories",
    """SELECT merchant_category, count(*) AS count FROM transactions
       WHERE merchant_category IS NOT NULL GROUP BY ALL ORDER BY 2, 1 LIMIT 3""",
)
def t25_rare_categories(t: DataFrame, n: int = 3) -> DataFrame:
    counts = t.filter("merchant_category IS NOT NULL").groupBy("merchant_category").agg(rows())
    return top(counts, n, "count", "merchant_category")


@on_transactions(
    "t26_null_category",
    "SELECT count(*) - count(merchant_category) AS null_count FROM transactions",
)
def t26_null_category(t: DataFrame) -> DataFrame:
    return t.filter("merchant_category IS NULL").agg(rows("null_count"))


@on_transactions(
    "t27_avg_by_tier", "SELECT amount_tier, avg(amount_inr) AS avg_amount FROM transactions GROUP BY ALL"
)
def t27_avg_by_tier(t: DataFrame) -> DataFrame:
    return t.groupBy("amount_tier").agg(F.avg("amount_inr").alias("avg_amount"))


@on_transactions(
    "t28_failure_by_hour",
    f"SELECT hour_of_day, {FAILURE_SQL} AS failure_rate FROM transactions GROUP BY ALL ORDER BY 1",
)
def t28_failure_by_hour(t: DataFrame) -> DataFrame:
    return t.groupBy("hour_of_day").agg(rate(failed()).alias("failure_rate")).orderBy("hour_of_day")


@on_transactions(
    "t29_p2p_p2m_ratio",
    """SELECT count(*) FILTER (WHERE transaction_type = 'P2P') * 1e0
              / count(*) FILTER (WHERE transaction_type = 'P2M') AS p2p_to_p2m_ratio FROM transactions""",
)
def t29_p2p_p2m_ratio(t: DataFrame) -> DataFrame:
    kind = F.col("transaction_type")
    ratio = F.try_divide(F.count_if(kind == "P2P").cast("double"), F.count_if(kind == "P2M"))
    return t.agg(ratio.alias("p2p_to_p2m_ratio"))


@on_transactions(
    "t30_summary",
    """SELECT count(*) AS total_txns, CAST(sum(amount_inr) AS BIGINT) AS total_amount,
              avg(amount_inr) AS avg_amount, CAST(sum(fraud_flag) AS BIGINT) AS fraud_count,
              count(*) FILTER (WHERE transaction_status = 'FAILED') AS failure_count FROM transactions""",
)
def t30_summary(t: DataFrame) -> DataFrame:
    return t.agg(
        rows("total_txns"),
        total_amount(),
        F.avg("amount_inr").alias("avg_amount"),
        F.sum("fraud_flag").alias("fraud_count"),
        F.count_if(failed()).alias("failure_count"),
    )
