"""The transaction fact frame as a projection of events, customer and nation.

`transactions` builds it on Spark, `with_transactions` gives the same rows as a
leading CTE for DuckDB. Both are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions import features as X
from tallywing.operators.joins import lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _age_group(n):
    return (
        F.when(n < 4, "18-25").when(n < 11, "26-35").when(n < 16, "36-45").when(n < 19, "46-55").otherwise("56+")
    )


def derive_transactions(events: DataFrame, event_time: str = "spread") -> DataFrame:
    """Every transaction column but `sender_state`, plus `user_id`.

    `spread` shifts each event by up to 335 days to fill a year; `arrival` keeps
    the original, nearly ordered time and so suits streams.
    """
    ts = "ts" if event_time == "arrival" else "ts + make_dt_interval(CAST((event_id * 131) % 336 AS INT))"
    e, u = F.col("event_id"), F.col("user_id")
    base = events.select(
        "event_id",
        "user_id",
        "event_type",
        F.floor(F.col("value") * 100).cast("int").alias("amount_inr"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.expr(ts).alias("timestamp"),
    )
    k, m, n = F.col("k"), e % 20, (e * 7 + u) % 20
    p2p = F.col("transaction_type") == "P2P"
    raw = X.with_calendar_columns(
        base.withColumn(
            "transaction_type",
            F.when(m < 7, "P2P").when(m < 14, "P2M").when(m < 18, "Bill Payment").otherwise("Recharge"),
        )
    ).select(
        "user_id",
        "event_id",
        X.transaction_key(e + 1).alias("transaction_id"),
        "timestamp",
        "transaction_type",
        F.when(~p2p, X.pick(S.MERCHANT_CATEGORIES, (e * 11 + k) % 10)).alias("merchant_category"),
        "amount_inr",
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("transaction_status"),
        _age_group(u % 20).alias("sender_age_group"),
        F.when(p2p, _age_group((e * 3 + k) % 20)).alias("receiver_age_group"),
        X.pick(S.BANKS, u % 8).alias("sender_bank"),
        X.pick(S.BANKS, (e * 5 + k) % 8).alias("receiver_bank"),
        F.when(k % 20 < 13, "Android").when(k % 20 < 18, "iOS").otherwise("Web").alias("device_type"),
        F.when(n < 1, "3G").when(n < 10, "4G").when(n < 16, "5G").otherwise("WiFi").alias("network_type"),
        "hour_of_day",
        "day_of_week",
        "is_weekend",
    )
    flagged = raw.withColumn(
        "fraud_flag", ((F.col("event_id") * 7919) % 1000 < X.row_risk_permille()).cast("int")
    )
    return X.with_derived_labels(flagged).drop("event_id")


def home_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, sender_state) of every known user."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return lookup(customer, nation, "c_nationkey").select(
        "user_id", X.pick(S.STATES, F.col("c_nationkey") % 15).alias("sender_state")
    )


def transactions(
    spark: SparkSession, sf_dir: str, with_state: bool = True, event_time: str = "spread"
) -> DataFrame:
    """All transaction columns; without `sender_state` no join is needed at all. An unknown user has a NULL state."""
    fact = derive_transactions(table(spark, sf_dir, "events"), event_time)
    if not with_state:
        return fact.select(*[c for c in S.TRANSACTION_COLUMNS if c != "sender_state"])
    home = home_states(spark, sf_dir)
    # A left join: a payment of an unknown user stays, without a state.
    return lookup(fact, home, "user_id", "left").select(*S.TRANSACTION_COLUMNS)


def _case_list(index: str, values: list[str]) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{items}], CAST({index} AS INTEGER) + 1)"


def _case_age(n: str) -> str:
    return (
        f"CASE WHEN {n} < 4 THEN '18-25' WHEN {n} < 11 THEN '26-35' "
        f"WHEN {n} < 16 THEN '36-45' WHEN {n} < 19 THEN '46-55' ELSE '56+' END"
    )


def _case_label(group: str) -> str:
    return (
        f"CASE {group} WHEN '18-25' THEN 'Young' WHEN '26-35' THEN 'Adult' "
        f"WHEN '36-45' THEN 'Adult' WHEN '46-55' THEN 'Adult' WHEN '56+' THEN 'Old' END"
    )


def _fact_cte(name: str, ts: str) -> str:
    return f"""{name}_base AS (
  SELECT e.*, {ts} AS t2, n_nationkey AS nk,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_id % 20 < 7 THEN 'P2P' WHEN event_id % 20 < 14 THEN 'P2M'
              WHEN event_id % 20 < 18 THEN 'Bill Payment' ELSE 'Recharge' END AS tt,
         CAST(floor(value * 100) AS INTEGER) AS amt, (event_id * 7 + user_id) % 20 AS n
  FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation ON n_nationkey = c.c_nationkey
), {name}_raw AS (
  SELECT event_id, user_id, 'TXN' || lpad(CAST(event_id + 1 AS VARCHAR), 10, '0') AS transaction_id,
         t2 AS "timestamp", tt AS transaction_type,
         CASE WHEN tt <> 'P2P' THEN {_case_list("(event_id * 11 + k) % 10", S.MERCHANT_CATEGORIES)} END
           AS merchant_category,
         amt AS amount_inr,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS transaction_status,
         {_case_age("user_id % 20")} AS sender_age_group,
         CASE WHEN tt = 'P2P' THEN {_case_age("(event_id * 3 + k) % 20")} END AS receiver_age_group,
         {_case_list("nk % 15", S.STATES)} AS sender_state,
         {_case_list("user_id % 8", S.BANKS)} AS sender_bank,
         {_case_list("(event_id * 5 + k) % 8", S.BANKS)} AS receiver_bank,
         CASE WHEN k % 20 < 13 THEN 'Android' WHEN k % 20 < 18 THEN 'iOS' ELSE 'Web' END AS device_type,
         CASE WHEN n < 1 THEN '3G' WHEN n < 10 THEN '4G' WHEN n < 16 THEN '5G' ELSE 'WiFi' END AS network_type,
         CAST(hour(t2) AS INTEGER) AS hour_of_day,
         {_case_list("isodow(t2) - 1", S.WEEKDAYS)} AS day_of_week,
         CAST(isodow(t2) >= 6 AS INTEGER) AS is_weekend
  FROM {name}_base
), {name}_risk AS (
  SELECT *, least(300, 20 + CASE WHEN amount_inr > 20000 THEN 80 WHEN amount_inr > 10000 THEN 40 ELSE 0 END
         + CASE WHEN hour_of_day < 5 OR hour_of_day > 22 THEN 50 ELSE 0 END
         + CASE WHEN network_type = '3G' THEN 30 ELSE 0 END
         + CASE WHEN device_type = 'Web' THEN 20 ELSE 0 END
         + CASE WHEN is_weekend = 1 THEN 10 ELSE 0 END
         + CASE WHEN transaction_type = 'P2P' AND amount_inr > 15000 THEN 30 ELSE 0 END) AS risk
  FROM {name}_raw
), {name} AS (
  SELECT transaction_id, "timestamp", transaction_type, merchant_category, amount_inr, transaction_status,
         sender_age_group, receiver_age_group, sender_state, sender_bank, receiver_bank, device_type,
         network_type, CAST((event_id * 7919) % 1000 < risk AS INTEGER) AS fraud_flag, hour_of_day,
         day_of_week, is_weekend,
         CASE WHEN hour_of_day >= 5 AND hour_of_day < 12 THEN 'Morning'
              WHEN hour_of_day >= 12 AND hour_of_day < 17 THEN 'Afternoon'
              WHEN hour_of_day >= 17 AND hour_of_day < 21 THEN 'Evening' ELSE 'Night' END AS day_part,
         CASE WHEN amount_inr < 500 THEN 'Small' WHEN amount_inr <= 5000 THEN 'Medium'
              WHEN amount_inr <= 50000 THEN 'Large' ELSE 'Very Large' END AS amount_tier,
         {_case_label("sender_age_group")} AS sender_age_label,
         {_case_label("receiver_age_group")} AS receiver_age_label,
         risk
  FROM {name}_risk
)"""


_SPREAD = "ts + to_days(CAST((event_id * 131) % 336 AS INTEGER))"


def with_transactions(sql: str, event_time: str = "spread") -> str:
    """Put the DuckDB twin of `transactions` in front of a query that reads it.

    The twin carries one more column, `risk`, the score in thousandths.
    """
    cte = _fact_cte("transactions", "ts" if event_time == "arrival" else _SPREAD)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {cte}, {body[5:]}"
    return f"WITH {cte} {body}"
