"""The fifty example questions, as functions of the transaction frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions import dates as D
from tallywing.functions import features as X
from tallywing.operators.aggregates import (
    failed, flag_rate, rate, share_of_total, succeeded, upper_median,
)
from tallywing.operators.ranking import top
from tallywing.plans.registry import on_transactions

FAILURE_SQL = "count(*) FILTER (WHERE transaction_status = 'FAILED') * 100e0 / count(*)"
SUCCESS_SQL = "count(*) FILTER (WHERE transaction_status = 'SUCCESS') * 100e0 / count(*)"
FRAUD_SQL = "sum(fraud_flag) * 100e0 / count(*)"


def total_amount(name: str = "total_amount"):
    return F.sum("amount_inr").alias(name)


def rows(name: str = "count"):
    return F.count("*").alias(name)


@on_transactions(
    "q01_bank_volume",
    "SELECT CAST(sum(amount_inr) AS BIGINT) AS total_amount FROM transactions WHERE sender_bank = 'SBI'",
)
def q01_bank_volume(t: DataFrame, bank: str = "SBI") -> DataFrame:
    return t.filter(F.col("sender_bank") == bank).agg(total_amount())


@on_transactions(
    "q02_bill_failure_rate",
    f"SELECT {FAILURE_SQL} AS failure_rate FROM transactions WHERE transaction_type = 'Bill Payment'",
)
def q02_bill_failure_rate(t: DataFrame, kind: str = "Bill Payment") -> DataFrame:
    return t.filter(F.col("transaction_type") == kind).agg(rate(failed()).alias("failure_rate"))


@on_transactions(
    "q03_top_age_food",
    """SELECT sender_age_label, CAST(sum(amount_inr) AS BIGINT) AS total_spent FROM transactions
       WHERE merchant_category = 'Food' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def q03_top_age_food(t: DataFrame, category: str = "Food") -> DataFrame:
    spent = t.filter(F.col("merchant_category") == category).groupBy("sender_age_label")
    return top(spent.agg(total_amount("total_spent")), 1, F.desc("total_spent"), "sender_age_label")


@on_transactions(
    "q04_peak_day_parts", "SELECT day_part, count(*) AS txn_count FROM transactions GROUP BY 1 ORDER BY 2 DESC"
)
def q04_peak_day_parts(t: DataFrame) -> DataFrame:
    return t.groupBy("day_part").agg(rows("txn_count")).orderBy(F.desc("txn_count"), "day_part")


@on_transactions(
    "q05_large_fraud_rate", f"SELECT {FRAUD_SQL} AS fraud_rate FROM transactions WHERE amount_tier = 'Large'"
)
def q05_large_fraud_rate(t: DataFrame, tier: str = "Large") -> DataFrame:
    return t.filter(F.col("amount_tier") == tier).agg(flag_rate().alias("fraud_rate"))


@on_transactions(
    "q06_3g_5g_failure",
    f"""SELECT network_type, {FAILURE_SQL} AS failure_rate FROM transactions
        WHERE network_type IN ('3G', '5G') GROUP BY 1""",
)
def q06_3g_5g_failure(t: DataFrame, networks: tuple[str, ...] = ("3G", "5G")) -> DataFrame:
    picked = t.filter(F.col("network_type").isin(*networks))
    return picked.groupBy("network_type").agg(rate(failed()).alias("failure_rate"))


@on_transactions(
    "q07_p2p_top_device",
    """SELECT device_type, count(*) AS count FROM transactions WHERE transaction_type = 'P2P'
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def q07_p2p_top_device(t: DataFrame) -> DataFrame:
    used = t.filter(F.col("transaction_type") == "P2P").groupBy("device_type").agg(rows())
    return top(used, 1, F.desc("count"), "device_type")


@on_transactions(
    "q08_cross_bank_failure",
    f"""SELECT CASE WHEN sender_bank = receiver_bank THEN 'Same-Bank' ELSE 'Cross-Bank' END AS bank_routing,
               {FAILURE_SQL} AS failure_rate FROM transactions GROUP BY 1""",
)
def q08_cross_bank_failure(t: DataFrame) -> DataFrame:
    routing = X.bank_routing(F.col("sender_bank"), F.col("receiver_bank")).alias("bank_routing")
    return t.groupBy(routing).agg(rate(failed()).alias("failure_rate"))


@on_transactions(
    "q09_young_vs_old",
    """SELECT sender_age_label, count(*) AS total_txns FROM transactions
       WHERE sender_age_label IN ('Young', 'Old') GROUP BY 1""",
)
def q09_young_vs_old(t: DataFrame, labels: tuple[str, ...] = ("Young", "Old")) -> DataFrame:
    return t.filter(F.col("sender_age_label").isin(*labels)).groupBy("sender_age_label").agg(rows("total_txns"))


@on_transactions("q10_weekend_fraud", f"SELECT is_weekend, {FRAUD_SQL} AS fraud_rate FROM transactions GROUP BY 1")
def q10_weekend_fraud(t: DataFrame) -> DataFrame:
    return t.groupBy("is_weekend").agg(flag_rate().alias("fraud_rate"))


@on_transactions(
    "q11_top_failed_state",
    """SELECT sender_state, count(*) AS failed_count FROM transactions WHERE transaction_status = 'FAILED'
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    state=True,
)
def q11_top_failed_state(t: DataFrame) -> DataFrame:
    lost = t.filter(failed()).groupBy("sender_state").agg(rows("failed_count"))
    return top(lost, 1, F.desc("failed_count"), "sender_state")


@on_transactions(
    "q12_avg_by_category",
    """SELECT merchant_category, avg(amount_inr) AS avg_amount FROM transactions
       WHERE transaction_type <> 'P2P' GROUP BY 1""",
)
def q12_avg_by_category(t: DataFrame) -> DataFrame:
    paid = t.filter(F.col("transaction_type") != "P2P")
    return paid.groupBy("merchant_category").agg(F.avg("amount_inr").alias("avg_amount"))


@on_transactions(
    "q13_top_receiver_age",
    """SELECT receiver_age_label, CAST(sum(amount_inr) AS BIGINT) AS total_received FROM transactions
       WHERE transaction_type = 'P2P' GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 1""",
)
def q13_top_receiver_age(t: DataFrame) -> DataFrame:
    got = t.filter(F.col("transaction_type") == "P2P").groupBy("receiver_age_label")
    return top(got.agg(total_amount("total_received")), 1, F.desc("total_received"), "receiver_age_label")


@on_transactions(
    "q14_top_fraud_txns",
    """SELECT transaction_id, amount_inr, sender_bank, receiver_bank FROM transactions
       WHERE fraud_flag = 1 ORDER BY amount_inr DESC, transaction_id LIMIT 5""",
)
def q14_top_fraud_txns(t: DataFrame, n: int = 5) -> DataFrame:
    hits = t.filter(F.col("fraud_flag") == 1)
    return top(
        hits.select("transaction_id", "amount_inr", "sender_bank", "receiver_bank"),
        n, F.desc("amount_inr"), "transaction_id",
    )


@on_transactions(
    "q15_night_morning_avg",
    """SELECT day_part, avg(amount_inr) AS avg_amount FROM transactions
       WHERE day_part IN ('Night', 'Morning') GROUP BY 1""",
)
def q15_night_morning_avg(t: DataFrame, parts: tuple[str, ...] = ("Night", "Morning")) -> DataFrame:
    return t.filter(F.col("day_part").isin(*parts)).groupBy("day_part").agg(F.avg("amount_inr").alias("avg_amount"))


@on_transactions(
    "q16_count_jan_2024",
    """SELECT count(*) AS txn_count FROM transactions
       WHERE month("timestamp") = 1 AND year("timestamp") = 2024""",
)
def q16_count_jan_2024(t: DataFrame, year: int = 2024, month: int = 1) -> DataFrame:
    return t.filter(D.in_month(F.col("timestamp"), year, month)).agg(rows("txn_count"))


@on_transactions(
    "q17_july_amount",
    """SELECT CAST(sum(amount_inr) AS BIGINT) AS total_amount FROM transactions WHERE month("timestamp") = 7""",
)
def q17_july_amount(t: DataFrame, month: int = 7) -> DataFrame:
    return t.filter(F.month("timestamp") == month).agg(total_amount())


@on_transactions(
    "q18_monthly_trend",
    """SELECT strftime("timestamp", '%Y-%m') AS month, count(*) AS txn_count,
              CAST(sum(amount_inr) AS BIGINT) AS total_amount FROM transactions GROUP BY 1 ORDER BY 1""",
)
def q18_monthly_trend(t: DataFrame) -> DataFrame:
    # Group by the month's first day; only the few groups are turned into text.
    by_month = t.groupBy(F.trunc("timestamp", "MM").alias("m")).agg(rows("txn_count"), total_amount())
    return by_month.select(D.year_month(F.col("m")).alias("month"), "txn_count", "total_amount").orderBy("month")


@on_transactions(
    "q19_top_fraud_month",
    """SELECT strftime("timestamp", '%m') AS month, CAST(sum(fraud_flag) AS BIGINT) AS fraud_count
       FROM transactions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def q19_top_fraud_month(t: DataFrame) -> DataFrame:
    by_month = t.groupBy(F.month("timestamp").alias("m")).agg(F.sum("fraud_flag").alias("fraud_count"))
    labelled = by_month.select(F.lpad(F.col("m").cast("string"), 2, "0").alias("month"), "fraud_count")
    return top(labelled, 1, F.desc("fraud_count"), "month")


@on_transactions(
    "q20_daily_avg_count",
    """SELECT avg(n) AS avg_daily_txns
       FROM (SELECT count(*) AS n FROM transactions GROUP BY CAST("timestamp" AS DATE)) d""",
)
def q20_daily_avg_count(t: DataFrame) -> DataFrame:
    per_day = t.groupBy(F.to_date("timestamp").alias("day")).agg(rows("n"))
    return per_day.agg(F.avg("n").alias("avg_daily_txns"))


@on_transactions(
    "q21_busy_banks",
    """SELECT sender_bank, count(*) AS txn_count FROM transactions GROUP BY 1
       HAVING count(*) > 1250 ORDER BY 2 DESC""",
    threshold=1250,
)
def q21_busy_banks(t: DataFrame, threshold: int = 10_000) -> DataFrame:
    banks = t.groupBy("sender_bank").agg(rows("txn_count"))
    return banks.filter(F.col("txn_count") > threshold).orderBy(F.desc("txn_count"), "sender_bank")


@on_transactions(
    "q22_states_fraud_above",
    f"""SELECT sender_state, {FRAUD_SQL} AS fraud_rate FROM transactions GROUP BY 1
        HAVING {FRAUD_SQL} > 1 ORDER BY 2 DESC""",
    state=True,
)
def q22_states_fraud_above(t: DataFrame, threshold: float = 1.0) -> DataFrame:
    states = t.groupBy("sender_state").agg(flag_rate().alias("fraud_rate"))
    return states.filter(F.col("fraud_rate") > threshold).orderBy(F.desc("fraud_rate"), "sender_state")


@on_transactions(
    "q23_median_amount",
    """SELECT amount_inr AS median_amount
       FROM (SELECT amount_inr, row_number() OVER (ORDER BY amount_inr) - 1 AS pos, count(*) OVER () AS n
             FROM transactions) s WHERE pos = n // 2""",
)
def q23_median_amount(t: DataFrame) -> DataFrame:
    return upper_median(t, "amount_inr", "median_amount")


@on_transactions(
    "q24_type_share",
    """SELECT transaction_type, count(*) AS count, count(*) * 100e0 / sum(count(*)) OVER () AS percentage
       FROM transactions GROUP BY 1 ORDER BY 3 DESC""",
)
def q24_type_share(t: DataFrame) -> DataFrame:
    return share_of_total(t.groupBy("transaction_type").agg(rows()), "count").orderBy(
        F.desc("percentage"), "transaction_type"
    )


@on_transactions(
    "q25_state_totals",
    """SELECT sender_state, count(*) AS txn_count, CAST(sum(amount_inr) AS BIGINT) AS total_amount,
              avg(amount_inr) AS avg_amount FROM transactions GROUP BY 1 ORDER BY 3 DESC""",
    state=True,
)
def q25_state_totals(t: DataFrame) -> DataFrame:
    states = t.groupBy("sender_state").agg(
        rows("txn_count"), total_amount(), F.avg("amount_inr").alias("avg_amount")
    )
    return states.orderBy(F.desc("total_amount"), "sender_state")


@on_transactions(
    "q26_failed_p2p_large",
    """SELECT transaction_id, amount_inr, sender_bank, receiver_bank FROM transactions
       WHERE transaction_type = 'P2P' AND transaction_status = 'FAILED' AND amount_inr > 5000
       ORDER BY amount_inr DESC""",
)
def q26_failed_p2p_large(t: DataFrame, above: int = 5000) -> DataFrame:
    hits = t.filter((F.col("transaction_type") == "P2P") & failed() & (F.col("amount_inr") > above))
    return hits.select("transaction_id", "amount_inr", "sender_bank", "receiver_bank").orderBy(
        F.desc("amount_inr"), "transaction_id"
    )


@on_transactions(
    "q27_weekend_night_fraud",
    """SELECT count(*) FILTER (WHERE fraud_flag = 1 AND is_weekend = 1 AND day_part = 'Night') AS fraud_count
       FROM transactions""",
)
def q27_weekend_night_fraud(t: DataFrame, part: str = "Night") -> DataFrame:
    hits = t.filter((F.col("fraud_flag") == 1) & (F.col("is_weekend") == 1) & (F.col("day_part") == part))
    return hits.agg(rows("fraud_count"))


@on_transactions(
    "q28_hdfc_sbi_failure",
    f"""SELECT {FAILURE_SQL} AS failure_rate FROM transactions
        WHERE sender_bank = 'HDFC' AND receiver_bank = 'SBI'""",
)
def q28_hdfc_sbi_failure(t: DataFrame, sender: str = "HDFC", receiver: str = "SBI") -> DataFrame:
    pair = t.filter((F.col("sender_bank") == sender) & (F.col("receiver_bank") == receiver))
    return pair.agg(rate(failed()).alias("failure_rate"))


@on_transactions(
    "q29_delhi_android_failed",
    """SELECT transaction_id, amount_inr, transaction_type, sender_bank FROM transactions
       WHERE sender_state = 'Delhi' AND device_type = 'Android' AND transaction_status = 'FAILED'
       ORDER BY amount_inr DESC""",
    state=True,
)
def q29_delhi_android_failed(t: DataFrame, state: str = "Delhi", device: str = "Android") -> DataFrame:
    hits = t.filter((F.col("sender_state") == state) & (F.col("device_type") == device) & failed())
    return hits.select("transaction_id", "amount_inr", "transaction_type", "sender_bank").orderBy(
        F.desc("amount_inr"), "transaction_id"
    )


@on_transactions(
    "q30_young_mh_shopping",
    """SELECT count(*) AS txn_count FROM transactions WHERE sender_age_label = 'Young'
       AND sender_state = 'Maharashtra' AND merchant_category = 'Shopping'""",
    state=True,
)
def q30_young_mh_shopping(
    t: DataFrame, label: str = "Young", state: str = "Maharashtra", category: str = "Shopping"
) -> DataFrame:
    hits = t.filter(
        (F.col("sender_age_label") == label)
        & (F.col("sender_state") == state)
        & (F.col("merchant_category") == category)
    )
    return hits.agg(rows("txn_count"))


@on_transactions(
    "q31_p2p_no_category",
    """SELECT count(*) FILTER (WHERE transaction_type = 'P2P' AND merchant_category IS NULL) AS count
       FROM transactions""",
)
def q31_p2p_no_category(t: DataFrame) -> DataFrame:
    return t.filter((F.col("transaction_type") == "P2P") & F.col("merchant_category").isNull()).agg(rows())


@on_transactions(
    "q32_nonp2p_no_receiver",
    """SELECT transaction_type, count(*) AS count FROM transactions
       WHERE transaction_type <> 'P2P' AND receiver_age_group IS NULL GROUP BY 1""",
)
def q32_nonp2p_no_receiver(t: DataFrame) -> DataFrame:
    hits = t.filter((F.col("transaction_type") != "P2P") & F.col("receiver_age_group").isNull())
    return hits.groupBy("transaction_type").agg(rows())


@on_transactions("q33_total", "SELECT count(*) AS total_transactions FROM transactions")
def q33_total(t: DataFrame) -> DataFrame:
    return t.agg(rows("total_transactions"))


@on_transactions(
    "q34_categories",
    """SELECT merchant_category FROM transactions WHERE merchant_category IS NOT NULL
       GROUP BY 1 ORDER BY 1""",
)
def q34_categories(t: DataFrame) -> DataFrame:
    return t.select("merchant_category").filter("merchant_category IS NOT NULL").distinct().orderBy("merchant_category")


@on_transactions("q35_states", "SELECT sender_state FROM transactions GROUP BY 1 ORDER BY 1", state=True)
def q35_states(t: DataFrame) -> DataFrame:
    return t.select("sender_state").distinct().orderBy("sender_state")


@on_transactions(
    "q36_risk_category",
    """SELECT CASE WHEN fraud_flag <> 1 THEN 'Low Risk' WHEN amount_inr > 5000 THEN 'High Risk'
                   ELSE 'Medium Risk' END AS risk_category, count(*) AS count FROM transactions GROUP BY 1""",
)
def q36_risk_category(t: DataFrame) -> DataFrame:
    return t.groupBy(X.risk_category(F.col("fraud_flag"), F.col("amount_inr")).alias("risk_category")).agg(rows())


@on_transactions(
    "q37_device_success",
    f"""SELECT device_type, count(*) AS total,
               count(*) FILTER (WHERE transaction_status = 'SUCCESS') AS success_count,
               {SUCCESS_SQL} AS success_rate FROM transactions GROUP BY 1 ORDER BY 4 DESC""",
)
def q37_device_success(t: DataFrame) -> DataFrame:
    devices = t.groupBy("device_type").agg(
        rows("total"), F.count_if(succeeded()).alias("success_count"), rate(succeeded()).alias("success_rate")
    )
    return devices.orderBy(F.desc("success_rate"), "device_type")


@on_transactions(
    "q38_network_device_failure",
    f"""SELECT network_type, device_type, count(*) AS total, {FAILURE_SQL} AS failure_rate
        FROM transactions GROUP BY 1, 2 ORDER BY 4 DESC""",
)
def q38_network_device_failure(t: DataFrame) -> DataFrame:
    pairs = t.groupBy("network_type", "device_type").agg(rows("total"), rate(failed()).alias("failure_rate"))
    return pairs.orderBy(F.desc("failure_rate"), "network_type", "device_type")


@on_transactions(
    "q39_peak_hours",
    """SELECT hour_of_day, count(*) AS txn_count,
              CASE WHEN count(*) > CAST(sum(count(*)) OVER () AS BIGINT) // 24 THEN 'Peak' ELSE 'Off-Peak' END
                AS hour_label FROM transactions GROUP BY 1 ORDER BY 1""",
)
def q39_peak_hours(t: DataFrame) -> DataFrame:
    hours = t.groupBy("hour_of_day").agg(rows("txn_count"))
    total = hours.agg(F.sum("txn_count")).scalar()
    return hours.withColumn("hour_label", X.peak_label(F.col("txn_count"), total)).orderBy("hour_of_day")


@on_transactions(
    "q40_bank_pair_failure",
    f"""SELECT sender_bank, receiver_bank, count(*) AS total, {FAILURE_SQL} AS failure_rate
        FROM transactions GROUP BY 1, 2 HAVING count(*) > 100 ORDER BY 4 DESC, 1, 2 LIMIT 5""",
)
def q40_bank_pair_failure(t: DataFrame, threshold: int = 100, n: int = 5) -> DataFrame:
    pairs = t.groupBy("sender_bank", "receiver_bank").agg(rows("total"), rate(failed()).alias("failure_rate"))
    return top(
        pairs.filter(F.col("total") > threshold), n, F.desc("failure_rate"), "sender_bank", "receiver_bank"
    )


@on_transactions(
    "q41_age_device_top",
    """SELECT sender_age_label, device_type, count(*) AS txn_count FROM transactions
       GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5""",
)
def q41_age_device_top(t: DataFrame, n: int = 5) -> DataFrame:
    pairs = t.groupBy("sender_age_label", "device_type").agg(rows("txn_count"))
    return top(pairs, n, F.desc("txn_count"), "sender_age_label", "device_type")


@on_transactions(
    "q42_dow_avg",
    """SELECT day_of_week, avg(amount_inr) AS avg_amount, count(*) AS txn_count FROM transactions
       GROUP BY 1 ORDER BY 2 DESC""",
)
def q42_dow_avg(t: DataFrame) -> DataFrame:
    days = t.groupBy("day_of_week").agg(F.avg("amount_inr").alias("avg_amount"), rows("txn_count"))
    return days.orderBy(F.desc("avg_amount"), "day_of_week")


@on_transactions(
    "q43_top_large_states",
    """SELECT sender_state, count(*) AS large_success_count FROM transactions
       WHERE amount_tier = 'Large' AND transaction_status = 'SUCCESS'
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    state=True,
)
def q43_top_large_states(t: DataFrame, tier: str = "Large", n: int = 3) -> DataFrame:
    hits = t.filter((F.col("amount_tier") == tier) & succeeded())
    return top(
        hits.groupBy("sender_state").agg(rows("large_success_count")),
        n, F.desc("large_success_count"), "sender_state",
    )


@on_transactions(
    "q44_bank_weekend_fraud",
    f"""SELECT sender_bank, if(is_weekend = 1, 'Weekend', 'Weekday') AS period, {FRAUD_SQL} AS fraud_rate
        FROM transactions GROUP BY 1, 2 ORDER BY 1, 2""",
)
def q44_bank_weekend_fraud(t: DataFrame) -> DataFrame:
    period = X.period_label(F.col("is_weekend")).alias("period")
    return t.groupBy("sender_bank", period).agg(flag_rate().alias("fraud_rate")).orderBy("sender_bank", "period")


@on_transactions(
    "q45_bottom_states",
    "SELECT sender_state, count(*) AS txn_count FROM transactions GROUP BY 1 ORDER BY 2, 1 LIMIT 5",
    state=True,
)
def q45_bottom_states(t: DataFrame, n: int = 5) -> DataFrame:
    return top(t.groupBy("sender_state").agg(rows("txn_count")), n, "txn_count", "sender_state")


@on_transactions(
    "q46_top_categories",
    """SELECT merchant_category, CAST(sum(amount_inr) AS BIGINT) AS total_revenue FROM transactions
       WHERE merchant_category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def q46_top_categories(t: DataFrame, n: int = 3) -> DataFrame:
    sold = t.filter("merchant_category IS NOT NULL").groupBy("merchant_category")
    return top(sold.agg(total_amount("total_revenue")), n, F.desc("total_revenue"), "merchant_category")


@on_transactions(
    "q47_recent",
    """SELECT transaction_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", transaction_type,
              amount_inr, sender_bank FROM transactions t
       ORDER BY t."timestamp" DESC, transaction_id LIMIT 10""",
)
def q47_recent(t: DataFrame, n: int = 10) -> DataFrame:
    newest = top(
        t.select("transaction_id", "timestamp", "transaction_type", "amount_inr", "sender_bank"),
        n, F.desc("timestamp"), "transaction_id",
    )
    return newest.withColumn("timestamp", D.iso_text(F.col("timestamp")))


@on_transactions(
    "q48_bank_rank",
    """SELECT sender_bank, CAST(sum(amount_inr) AS BIGINT) AS total_amount, count(*) AS txn_count
       FROM transactions GROUP BY 1 ORDER BY 2 DESC""",
)
def q48_bank_rank(t: DataFrame) -> DataFrame:
    banks = t.groupBy("sender_bank").agg(total_amount(), rows("txn_count"))
    return banks.orderBy(F.desc("total_amount"), "sender_bank")


@on_transactions(
    "q49_top_fraud_hour",
    f"""SELECT hour_of_day, {FRAUD_SQL} AS fraud_rate, count(*) AS total FROM transactions
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def q49_top_fraud_hour(t: DataFrame) -> DataFrame:
    hours = t.groupBy("hour_of_day").agg(flag_rate().alias("fraud_rate"), rows("total"))
    return top(hours, 1, F.desc("fraud_rate"), "hour_of_day")


@on_transactions(
    "q50_type_summary",
    f"""SELECT transaction_type, count(*) AS count, CAST(sum(amount_inr) AS BIGINT) AS total_amount,
               avg(amount_inr) AS avg_amount, {FAILURE_SQL} AS failure_rate
        FROM transactions GROUP BY 1 ORDER BY 2 DESC""",
)
def q50_type_summary(t: DataFrame) -> DataFrame:
    kinds = t.groupBy("transaction_type").agg(
        rows(), total_amount(), F.avg("amount_inr").alias("avg_amount"), rate(failed()).alias("failure_rate")
    )
    return kinds.orderBy(F.desc("count"), "transaction_type")
