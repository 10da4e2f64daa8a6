"""Each column function over a whole driver table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing.functions import dates as D
from tallywing.functions import features as X
from tallywing.functions import text as TX
from tallywing.operators.aggregates import failed
from tallywing.plans.corpus import rows
from tallywing.plans.registry import on_transactions, register
from tallywing.sources.fixture import table


@on_transactions(
    "f01_day_part",
    """SELECT hour_of_day, day_part AS stored,
              CASE WHEN hour_of_day BETWEEN 6 AND 11 THEN 'Morning' WHEN hour_of_day BETWEEN 12 AND 17 THEN 'Afternoon'
                   WHEN hour_of_day BETWEEN 18 AND 21 THEN 'Evening' ELSE 'Night' END AS dictionary,
              count(*) AS count FROM transactions GROUP BY ALL""",
)
def f01_day_part(t: DataFrame) -> DataFrame:
    hour = F.col("hour_of_day")
    return t.groupBy(hour).agg(rows()).select(
        hour, X.day_part(hour).alias("stored"), X.day_part(hour, "dictionary").alias("dictionary"), "count"
    )


@on_transactions(
    "f02_amount_tier",
    """SELECT amount_tier AS short,
              CASE amount_tier WHEN 'Small' THEN 'Small (<500)' WHEN 'Medium' THEN 'Medium (500-5000)'
                   ELSE 'Large (5000-50000)' END AS long,
              count(*) AS count, min(amount_inr) AS lowest, max(amount_inr) AS highest
       FROM transactions GROUP BY 1, 2""",
)
def f02_amount_tier(t: DataFrame) -> DataFrame:
    amount = F.col("amount_inr")
    return t.groupBy(
        X.amount_tier(amount).alias("short"), X.amount_tier(amount, "long").alias("long")
    ).agg(rows(), F.min(amount).alias("lowest"), F.max(amount).alias("highest"))


@on_transactions(
    "f03_age_label",
    """SELECT sender_age_group, sender_age_label AS short,
              CASE sender_age_label WHEN 'Young' THEN 'Young (18-25)' WHEN 'Adult' THEN 'Adult (26-55)'
                   WHEN 'Old' THEN 'Old (56+)' END AS long, count(*) AS count FROM transactions GROUP BY ALL""",
)
def f03_age_label(t: DataFrame) -> DataFrame:
    group = F.col("sender_age_group")
    return t.groupBy(group).agg(rows()).select(
        group, X.age_label(group).alias("short"), X.age_label(group, "long").alias("long"), "count"
    )


@register(
    "f04_calendar_columns",
    """SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, dayname(ts) AS day_of_week,
              CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, count(*) AS count FROM events GROUP BY ALL""",
)
def f04_calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        X.with_calendar_columns(table(spark, sf_dir, "events"), "ts")
        .groupBy("hour_of_day", "day_of_week", "is_weekend")
        .agg(rows())
    )


@register(
    "f05_transaction_key",
    "SELECT o_orderkey, printf('TXN%010d', o_orderkey) AS transaction_id FROM orders",
)
def f05_transaction_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.transaction_key(F.col("o_orderkey")).alias("transaction_id")
    )


@on_transactions(
    "f06_rule_risk_score",
    """SELECT risk / 1000e0 AS risk_score, count(*) AS count, CAST(sum(fraud_flag) AS BIGINT) AS fraud_count
       FROM transactions GROUP BY 1""",
)
def f06_rule_risk_score(t: DataFrame) -> DataFrame:
    return X.rule_risk_score(t).groupBy("risk_score").agg(rows(), F.sum("fraud_flag").alias("fraud_count"))


@on_transactions(
    "f07_null_if_not_applicable",
    """SELECT transaction_type, count(merchant_category) AS with_category,
              count(receiver_age_group) AS with_receiver FROM transactions GROUP BY 1""",
)
def f07_null_if_not_applicable(t: DataFrame) -> DataFrame:
    filled = t.fillna({"merchant_category": "Other", "receiver_age_group": "56+", "receiver_age_label": "Old"})
    return X.null_if_not_applicable(filled).groupBy("transaction_type").agg(
        F.count("merchant_category").alias("with_category"), F.count("receiver_age_group").alias("with_receiver")
    )


@on_transactions(
    "f08_date_parts",
    """SELECT strftime("timestamp", '%Y') AS year, strftime("timestamp", '%m') AS month,
              strftime("timestamp", '%Y-%m') AS year_month, strftime("timestamp", '%Y-%m-%d') AS day,
              count(*) AS count FROM transactions GROUP BY ALL""",
)
def f08_date_parts(t: DataFrame) -> DataFrame:
    d = F.col("d")
    return t.groupBy(F.to_date("timestamp").alias("d")).agg(rows()).select(
        D.year_of(d).alias("year"), D.month_of(d).alias("month"), D.year_month(d).alias("year_month"),
        D.day_of(d).alias("day"), "count",
    )


@on_transactions(
    "f09_bank_routing",
    """SELECT if(sender_bank = receiver_bank, 'Same-Bank', 'Cross-Bank') AS bank_routing, count(*) AS count,
              CAST(sum(amount_inr) AS BIGINT) AS total_amount FROM transactions GROUP BY 1""",
)
def f09_bank_routing(t: DataFrame) -> DataFrame:
    routing = X.bank_routing(F.col("sender_bank"), F.col("receiver_bank"))
    return t.groupBy(routing.alias("bank_routing")).agg(rows(), F.sum("amount_inr").alias("total_amount"))


@on_transactions(
    "f10_risk_category",
    """SELECT CASE WHEN fraud_flag = 0 THEN 'Low Risk' WHEN amount_inr <= 5000 THEN 'Medium Risk'
                   ELSE 'High Risk' END AS risk_category, CAST(sum(amount_inr) AS BIGINT) AS total_amount
       FROM transactions GROUP BY 1""",
)
def f10_risk_category(t: DataFrame) -> DataFrame:
    category = X.risk_category(F.col("fraud_flag"), F.col("amount_inr"))
    return t.groupBy(category.alias("risk_category")).agg(F.sum("amount_inr").alias("total_amount"))


@on_transactions(
    "f11_risk_level",
    """SELECT round(risk / 300e0, 4) AS probability,
              CASE WHEN risk / 300e0 >= 0.7 THEN 'High' WHEN risk / 300e0 >= 0.3 THEN 'Medium' ELSE 'Low' END
                AS risk_level,
              if(risk / 300e0 >= 0.5, 'FRAUD', 'LEGITIMATE') AS prediction, count(*) AS count
       FROM transactions GROUP BY ALL""",
)
def f11_risk_level(t: DataFrame) -> DataFrame:
    """Levels and verdicts of the rule score, stretched to 0..1."""
    p = F.col("p")
    return t.groupBy((X.row_risk_permille() / F.lit(300.0)).alias("p")).agg(rows()).select(
        F.round(p, 4).alias("probability"), X.risk_level(p).alias("risk_level"),
        X.verdict(p).alias("prediction"), "count",
    )


@on_transactions(
    "f12_period_label",
    """SELECT if(is_weekend = 1, 'Weekend', 'Weekday') AS period, count(*) AS count,
              avg(amount_inr) AS avg_amount FROM transactions GROUP BY 1""",
)
def f12_period_label(t: DataFrame) -> DataFrame:
    return t.groupBy(X.period_label(F.col("is_weekend")).alias("period")).agg(
        rows(), F.avg("amount_inr").alias("avg_amount")
    )


@on_transactions(
    "f13_peak_label",
    """SELECT hour_of_day, count(*) AS failed_count,
              if(count(*) > (SELECT count(*) // 24 FROM transactions WHERE transaction_status = 'FAILED'),
                 'Peak', 'Off-Peak') AS hour_label
       FROM transactions WHERE transaction_status = 'FAILED' GROUP BY 1""",
)
def f13_peak_label(t: DataFrame) -> DataFrame:
    hours = t.filter(failed()).groupBy("hour_of_day").agg(rows("failed_count"))
    total = hours.agg(F.sum("failed_count")).scalar()
    return hours.withColumn("hour_label", X.peak_label(F.col("failed_count"), total))


@on_transactions(
    "f14_fill_unknown",
    """SELECT coalesce(merchant_category, 'Unknown') AS merchant_category,
              coalesce(receiver_age_label, 'Unknown') AS receiver_age_label, count(*) AS count
       FROM transactions GROUP BY ALL""",
)
def f14_fill_unknown(t: DataFrame) -> DataFrame:
    columns = ["merchant_category", "receiver_age_label"]
    return X.fill_unknown(t, columns).groupBy(*columns).agg(rows())


@register(
    "f15_coalesce_number",
    """SELECT o_orderpriority, CAST(left(o_orderpriority, 1) AS DOUBLE) AS level, 0e0 AS whole_text,
              count(*) AS count FROM orders GROUP BY ALL""",
)
def f15_coalesce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(priority).agg(rows()).select(
        priority,
        TX.coalesce_number(F.substring(priority, 1, 1)).alias("level"),
        TX.coalesce_number(priority).alias("whole_text"),
        "count",
    )


# Indian grouping in DuckDB: turn the digits round, set commas after three and then every two.
_GROUPED = """CASE WHEN length({w}) <= 3 THEN {w} ELSE
  reverse(left(reverse({w}), 3) || regexp_replace(substr(reverse({w}), 4), '(..?)', ',\\1', 'g')) END"""


@register(
    "f16_format_inr",
    f"""SELECT o_orderkey, '₹' || {_GROUPED.format(w="split_part(s, '.', 1)")}
               || if(rtrim(split_part(s, '.', 2), '0') = '', '', '.' || rtrim(split_part(s, '.', 2), '0')) AS price,
               {_GROUPED.format(w="CAST(o_orderkey * 12345 AS VARCHAR)")} AS number
        FROM (SELECT *, printf('%.3f', o_totalprice) AS s FROM orders)""",
)
def f16_format_inr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        TX.format_inr(F.col("o_totalprice"), "o_totalprice").alias("price"),
        TX.format_inr(F.col("o_orderkey") * 12345, "o_orderkey").alias("number"),
    )


@register(
    "f17_truncate_title",
    """SELECT conv_id, turn, left(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), 60)
              || if(length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) > 60, '...', '') AS title
       FROM conversations""",
)
def f17_truncate_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", TX.truncate_title(F.col("text")).alias("title")
    )


@register(
    "f18_age_bucket",
    """WITH a AS (SELECT max(ts) AS now FROM events),
            m AS (SELECT (epoch_us(now) - epoch_us(ts)) // 60000000 AS m FROM events, a)
       SELECT CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h'
                   WHEN m < 10080 THEN (m // 1440) || 'd' ELSE (m // 10080) || 'w' END AS age, count(*) AS count
       FROM m GROUP BY 1""",
)
def f18_age_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    return events.groupBy(TX.age_bucket(F.col("ts"), now).alias("age")).agg(rows())


@register(
    "f19_query_fingerprint",
    """SELECT conv_id, turn, md5(length(role) || ':' || role || length(text) || ':' || text) AS fingerprint
       FROM conversations""",
)
def f19_query_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", TX.fingerprint(F.col("role"), F.col("text")).alias("fingerprint")
    )


@register(
    "f20_parse_payload",
    """SELECT event_id, if(event_type = 'error', NULL, CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k
       FROM events""",
)
def f20_parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field `k` of every payload; the payloads of errors are cut short first."""
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    json = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = table(spark, sf_dir, "events").select("event_id", TX.parse_payload(json, schema).alias("p"))
    return parsed.select("event_id", "p.k")
