"""Conversation, result-evaluation and report-shaping operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions.text import fingerprint
from tallywing.operators import conversations as C
from tallywing.operators import evaluation as E
from tallywing.operators import shaping as R
from tallywing.plans import benchmark as B
from tallywing.plans import corpus as Q
from tallywing.plans.corpus import rows
from tallywing.plans.registry import on_transactions, register
from tallywing.session import exists, fingerprint_of_files, remove, scratch_path, shared_dir
from tallywing.sources.fixture import table, transactions, with_transactions

TRIM = "trim(text, chr(32) || chr(9) || chr(10) || chr(13))"


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


SESSIONS_SQL = f"""SELECT conv_id,
    coalesce(first(left({TRIM}, 60) || if(length({TRIM}) > 60, '...', '') ORDER BY turn)
             FILTER (WHERE role = 'user'), 'New chat') AS title,
    min(turn) AS created_at, max(turn) AS updated_at, count(*) AS messages FROM conversations GROUP BY 1"""


@register("c01_sessions_rollup", SESSIONS_SQL)
def c01_sessions_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sessions_rollup(messages_of(spark, sf_dir))


@register("c02_auto_title", f"SELECT title, count(*) AS sessions FROM ({SESSIONS_SQL}) GROUP BY 1")
def c02_auto_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sessions_rollup(messages_of(spark, sf_dir)).groupBy("title").agg(rows("sessions"))


@register(
    "c03_list_sessions",
    f"SELECT * FROM ({SESSIONS_SQL}) ORDER BY updated_at DESC, conv_id LIMIT 50",
)
def c03_list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_sessions(C.sessions_rollup(messages_of(spark, sf_dir)))


@register(
    "c04_session_messages",
    """SELECT turn, role, text FROM conversations
       WHERE conv_id = (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
)
def c04_session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the longest session."""
    messages = messages_of(spark, sf_dir)
    longest = messages.groupBy("conv_id").agg(rows("n")).orderBy(F.desc("n"), "conv_id").limit(1)
    return C.session_messages(messages, longest.select("conv_id").scalar()).select("turn", "role", "text")


@register(
    "c05_delete_sessions",
    """SELECT conv_id, count(*) AS messages FROM conversations
       WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1""",
)
def c05_delete_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when every session opened with instructions is deleted."""
    messages = messages_of(spark, sf_dir)
    sessions = C.sessions_rollup(messages)
    gone = messages.filter("role = 'system'").select("conv_id")
    kept_sessions, kept_messages = C.delete_sessions(sessions, messages, gone)
    counted = kept_messages.groupBy("conv_id").agg(rows("messages"))
    return kept_sessions.select("conv_id").join(counted, "conv_id")


@register(
    "j01_cascade_delete",
    """SELECT role, count(*) AS messages FROM conversations
       WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) < 4) GROUP BY 1""",
)
def j01_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per role once sessions of fewer than four messages are gone."""
    messages = messages_of(spark, sf_dir)
    sessions = messages.groupBy("conv_id").agg(rows("n"))
    _, kept = C.delete_sessions(sessions, messages, sessions.filter("n < 4"))
    return kept.groupBy("role").agg(rows("messages"))


@register(
    "c06_history_window",
    """SELECT conv_id, string_agg(role || '/' || turn || '/' || md5(text), ';' ORDER BY turn) AS history
       FROM (SELECT * FROM conversations
             QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1""",
)
def c06_history_window(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    """The last messages of each session, one line per session."""
    windows = C.history_window(messages_of(spark, sf_dir), n)
    line = F.transform(
        "history", lambda h: F.concat_ws("/", h["role"], h["turn"].cast("string"), F.md5(h["content"]))
    )
    return windows.select("conv_id", F.array_join(line, ";").alias("history"))


@register(
    "c07_question_answer_pairs",
    """SELECT conv_id, turn, coalesce(q, 'Insight') AS question, text AS answer
       FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
                         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q
             FROM conversations) WHERE role = 'assistant'""",
)
def c07_question_answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.question_answer_pairs(messages_of(spark, sf_dir))


@register(
    "c08_non_empty_history",
    """SELECT if(role = 'user', 'user', 'assistant') AS role, count(*) AS messages,
              CAST(sum(length(text)) AS BIGINT) AS characters
       FROM conversations WHERE trim(text) <> '' GROUP BY 1""",
)
def c08_non_empty_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.non_empty_history(messages_of(spark, sf_dir))
    return kept.groupBy("role").agg(rows("messages"), F.sum(F.length("text")).alias("characters"))


@register(
    "c09_repeat_question_hits",
    """SELECT count(*) AS requests, count(*) FILTER (WHERE gap <= 900000000) AS hits,
              count(*) FILTER (WHERE gap <= 900000000) * 100e0 / count(*) AS hit_rate
       FROM (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) AS gap
             FROM events)""",
)
def c09_repeat_question_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within 15 minutes; a request is a user with an event type."""
    return C.repeat_share(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@register(
    "c09_repeat_hits_hour",
    """SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 3600000000,
                                 false) AS hit FROM events""",
)
def c09_repeat_hits_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, with whether its user had another one in the hour before."""
    return C.repeat_hits(table(spark, sf_dir, "events"), ["user_id"], ttl_seconds=3600).select("event_id", "hit")


@register(
    "f19_request_keys",
    """WITH h AS (
         SELECT c.conv_id, c.turn, any_value(c.text) AS question,
                coalesce(string_agg(md5(length(p.role) || ':' || p.role || length(p.text) || ':' || p.text), ','
                                    ORDER BY p.turn), '') AS turns
         FROM conversations c LEFT JOIN conversations p
           ON p.conv_id = c.conv_id AND p.turn < c.turn AND p.turn >= c.turn - 6
         WHERE c.role = 'user' GROUP BY 1, 2)
       SELECT conv_id, turn,
              md5(length(trim(question)) || ':' || trim(question) || length(turns) || ':' || turns) AS request_key
       FROM h""",
)
def f19_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache key of every question: its text and the six turns before it."""
    messages = messages_of(spark, sf_dir)
    turn = F.struct("turn", fingerprint(F.col("role"), F.col("text")).alias("print"))
    # Each message joins the history of the next six turns: at most six copies of its fingerprint, not of its text.
    spread = messages.select(
        "conv_id", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + 6)).alias("at"), turn.alias("past")
    )
    history = spread.groupBy("conv_id", F.col("at").alias("turn")).agg(
        F.sort_array(F.collect_list("past")).alias("history")
    )
    asked = messages.filter("role = 'user'").join(history, ["conv_id", "turn"], "left")
    turns = F.coalesce(F.col("history.print"), F.array().cast("array<string>"))
    return asked.select("conv_id", "turn", C.request_key_of(F.col("text"), turns).alias("request_key"))


#: Columns of the fact table that the benchmark's queries read.
BENCHMARK_COLUMNS = [
    "transaction_id", "timestamp", "transaction_type", "merchant_category", "amount_inr", "transaction_status", "sender_age_group",
    "sender_state", "sender_bank", "device_type", "network_type", "fraud_flag", "hour_of_day", "day_of_week", "is_weekend",
    "amount_tier", "sender_age_label", "day_part",
]


def benchmark_cases(t: DataFrame) -> list[E.Case]:
    """All thirty benchmark questions against an independently written answer to each.

    Some answers are wrong on purpose; one is rejected by the analyzer, one fails while it runs, and one is missing.
    """
    failing = F.expr("CASE WHEN transaction_status = 'FAILED' THEN 1 ELSE 0 END")
    other = {
        "t01_total": lambda: Q.q33_total(t),
        "t02_success_amount": lambda: t.agg(F.sum(F.when(F.expr("transaction_status = 'SUCCESS'"), F.col("amount_inr")))),
        "t03_distinct_banks": lambda: t.select("sender_bank").distinct().agg(F.count("*")),
        "t04_ios_count": lambda: t.filter("device_type = 'iOS'").agg(F.count("transaction_id")),
        "t05_avg_failed": lambda: t.agg(F.avg(F.expr("CASE WHEN transaction_status = 'FAILED' THEN amount_inr END"))),
        "t06_weekday_fraud": lambda: t.filter(~F.col("day_of_week").isin(S.WEEKDAYS[5:])).agg(F.sum("fraud_flag")),
        "t07_by_device": lambda: t.groupBy("device_type").count().orderBy("device_type"),
        "t08_bank_amount": lambda: t.groupBy("sender_bank").agg(F.sum("amount_inr").cast("double")),
        "t09_by_type": lambda: Q.q24_type_share(t).select("transaction_type", "count"),
        "t10_march": lambda: t.filter("date_format(timestamp, 'MM') = '03'").groupBy().count(),
        "t11_monthly_amount": lambda: Q.q18_monthly_trend(t).select("month", "total_amount"),
        "t12_top_dow": lambda: t.groupBy("no_such_column").count(),
        "t13_fraud_rate": lambda: t.agg(F.avg("fraud_flag") * 100.0),
        "t14_success_by_network": lambda: t.groupBy("network_type").agg(
            F.sum(F.expr("int(transaction_status = 'SUCCESS')")) * F.lit(100.0) / F.count("*")
        ),
        "t15_p2p_pct": lambda: t.agg(F.count(F.expr("nullif(transaction_type = 'P2P', false)")) * F.lit(100.0) / F.count("*")),
        "t16_large_p2p_success": lambda: t.filter(
            "transaction_type = 'P2P' AND transaction_status = 'SUCCESS' AND amount_inr > 5000 AND amount_inr <= 50000"
        ).agg(F.count("*")),
        "t17_failed_recharge_wifi": lambda: B.t17_failed_recharge_wifi(t).select("transaction_id", "amount_inr"),
        "t18_karnataka_fraud_avg": lambda: t.filter(
            "fraud_flag = 1 AND sender_state = 'Karnataka' AND network_type = '4G'"
        ).agg(F.try_divide(F.sum("amount_inr"), F.count("*"))),
        "t19_busy_categories": lambda: t.groupBy("merchant_category").count(),
        "t20_banks_high_failure": lambda: t.groupBy("sender_bank")
        .agg((F.sum(failing) * F.lit(100.0) / F.count("*")).alias("r")).filter("r > 10"),
        "t21_fraud_by_age": lambda: t.groupBy("sender_age_group").agg(F.avg("fraud_flag") * 100.0),
        "t22_state_by_type": lambda: t.groupBy("transaction_type", "sender_state").count().select("sender_state", "transaction_type", "count"),
        "t23_top_state": lambda: t.groupBy("sender_state").count().orderBy(F.desc("count"), "sender_state").limit(1),
        "t24_top_banks_avg": lambda: t.groupBy("sender_bank").agg((F.sum("amount_inr") / F.count("*")).alias("a"))
        .orderBy(F.desc("a"), "sender_bank").limit(5),
        "t25_rare_categories": lambda: t.groupBy("merchant_category").agg(F.count("merchant_category").alias("n"))
        .filter("n > 0").orderBy("n", "merchant_category").limit(3),
        "t26_null_category": lambda: t.agg(F.count_if(F.expr("merchant_category IS NULL"))),
        "t27_avg_by_tier": lambda: t.groupBy(
            F.expr("CASE WHEN amount_inr < 500 THEN 'Small' WHEN amount_inr <= 5000 THEN 'Medium'"
                   " WHEN amount_inr <= 50000 THEN 'Large' ELSE 'Very Large' END")
        ).agg(F.sum("amount_inr") / F.count("*")),
        "t28_failure_by_hour": lambda: t.groupBy(F.col("day_part").cast("int")).agg(F.avg(failing) * 100.0),
        "t29_p2p_p2m_ratio": None,
        "t30_summary": lambda: B.t30_summary(t),
    }
    return [
        E.Case(name, category, lambda gold=getattr(B, name): gold(t), other[name])
        for category, names in B.CATEGORIES.items() for name in names
    ]


def _n(what: str) -> str:
    return f"(SELECT count(*) FROM ({what}))"


_BY = {c: _n(f"SELECT DISTINCT {c} FROM transactions") for c in (
    "device_type", "transaction_type", "sender_bank", "network_type", "sender_age_label", "sender_age_group", "merchant_category",
    "amount_tier", "hour_of_day", "sender_state, transaction_type", "date_trunc('month', \"timestamp\")",
)}
_WIFI = _n("""SELECT 1 FROM transactions WHERE transaction_type = 'Recharge' AND transaction_status = 'FAILED' AND network_type = 'WiFi'""")
_BUSY = _n("SELECT 1 FROM transactions WHERE merchant_category IS NOT NULL GROUP BY merchant_category HAVING count(*) > 5000")
_RISKY = _n("""SELECT 1 FROM transactions GROUP BY sender_bank
               HAVING count(*) FILTER (WHERE transaction_status = 'FAILED') * 100e0 / count(*) > 10""")
_RATE = "(SELECT if(sum(fraud_flag) * 100e0 / count(*) = avg(fraud_flag) * 100e0, 'PASS', 'FAIL') FROM transactions)"
_MONTHS = _BY["date_trunc('month', \"timestamp\")"]

# What each case must come to: status and the sizes of both results.
_OUTCOMES = {
    "t01_total": ("'PASS'", 1, 1), "t02_success_amount": ("'PASS'", 1, 1), "t03_distinct_banks": ("'PASS'", 1, 1),
    "t04_ios_count": ("'PASS'", 1, 1), "t05_avg_failed": ("'PASS'", 1, 1), "t06_weekday_fraud": ("'PASS'", 1, 1),
    "t07_by_device": ("'PASS'", _BY["device_type"], _BY["device_type"]),
    "t08_bank_amount": ("'PASS'", _BY["sender_bank"], _BY["sender_bank"]),
    "t09_by_type": ("'PASS'", _BY["transaction_type"], _BY["transaction_type"]),
    "t10_march": ("'PASS'", 1, 1), "t11_monthly_amount": ("'PASS'", _MONTHS, _MONTHS), "t12_top_dow": ("'SQL_ERROR'", 1, 0),
    "t13_fraud_rate": (_RATE, 1, 1), "t14_success_by_network": ("'PASS'", _BY["network_type"], _BY["network_type"]),
    "t15_p2p_pct": ("'PASS'", 1, 1), "t16_large_p2p_success": ("'PASS'", 1, 1), "t17_failed_recharge_wifi": ("'FAIL'", _WIFI, _WIFI),
    "t18_karnataka_fraud_avg": ("'PASS'", 1, 1), "t19_busy_categories": ("'FAIL'", _BUSY, _BY["merchant_category"]),
    "t20_banks_high_failure": ("'PASS'", _RISKY, _RISKY), "t21_fraud_by_age": ("'FAIL'", _BY["sender_age_label"], _BY["sender_age_group"]),
    "t22_state_by_type": ("'PASS'", _BY["sender_state, transaction_type"], _BY["sender_state, transaction_type"]),
    "t23_top_state": ("'PASS'", 1, 1), "t24_top_banks_avg": ("'PASS'", f"least(5, {_BY['sender_bank']})", f"least(5, {_BY['sender_bank']})"),
    "t25_rare_categories": ("'PASS'", 3, 3), "t26_null_category": ("'PASS'", 1, 1),
    "t27_avg_by_tier": ("'PASS'", _BY["amount_tier"], _BY["amount_tier"]), "t28_failure_by_hour": ("'SQL_ERROR'", _BY["hour_of_day"], 0),
    "t29_p2p_p2m_ratio": ("'ERROR'", 1, 0), "t30_summary": ("'PASS'", 1, 1),
}
OUTCOMES_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS id, '{category}' AS category, {_OUTCOMES[name][0]} AS status, CAST({_OUTCOMES[name][1]} AS BIGINT) AS gold_rows,
               CAST({_OUTCOMES[name][2]} AS BIGINT) AS gen_rows"""
    for category, names in B.CATEGORIES.items() for name in names
)


def _outcomes_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the outcomes for these tables are kept; another place once a table is written anew."""
    files = [f for name in ("events", "customer", "nation") for f in table(spark, sf_dir, name).inputFiles()]
    return f"{shared_dir(spark)}/tallywing/benchmark-outcomes-{fingerprint_of_files(spark, files)}"


@register("e02_run_benchmark", with_transactions(OUTCOMES_SQL))
def e02_run_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirty cases. The fact table is scanned once, for a copy of the columns that the cases read."""
    copy = scratch_path(spark, "benchmark-facts")
    t = transactions(spark, sf_dir, True).select(*BENCHMARK_COLUMNS)
    t.write.parquet(copy)
    done = E.run_benchmark(spark, benchmark_cases(spark.read.schema(t.schema).parquet(copy)), _outcomes_path(spark, sf_dir))
    remove(spark, copy)
    return done


@register(
    "e03_scoreboard",
    with_transactions(
        f"""SELECT category, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
               count(*) FILTER (WHERE status IN ('FAIL', 'SQL_ERROR')) AS failed,
               count(*) FILTER (WHERE status = 'ERROR') AS errors,
               round(count(*) FILTER (WHERE status = 'PASS') * 100e0 / count(*), 2) AS accuracy_pct
        FROM ({OUTCOMES_SQL}) GROUP BY ROLLUP (category)"""
    ),
)
def e03_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the stored outcomes of these tables, which `e02_run_benchmark` writes; it is run only where there are none."""
    path = _outcomes_path(spark, sf_dir)
    known = exists(spark, f"{path}/_SUCCESS")
    return E.scoreboard(spark.read.parquet(path) if known else e02_run_benchmark(spark, sf_dir))


@on_transactions(
    "e01_results_match",
    """WITH a AS (SELECT sender_bank, amount_inr FROM transactions WHERE transaction_type = 'P2P'),
            b AS (SELECT receiver_bank, amount_inr FROM transactions WHERE transaction_type = 'P2P')
       SELECT 'itself' AS against, (SELECT count(*) FROM a) AS gold_rows, (SELECT count(*) FROM a) AS gen_rows,
              true AS matched
       UNION ALL SELECT 'receivers', (SELECT count(*) FROM a), (SELECT count(*) FROM b),
              NOT EXISTS (FROM a EXCEPT ALL FROM b)""",
)
def e01_results_match(t: DataFrame) -> DataFrame:
    """Sender rows against themselves, renamed and sorted, and against receiver rows."""
    p2p = t.filter("transaction_type = 'P2P'")
    gold = p2p.select("sender_bank", "amount_inr")
    same = p2p.orderBy("amount_inr").select(F.col("sender_bank").alias("bank"), F.col("amount_inr").cast("long"))
    other = p2p.select("receiver_bank", "amount_inr")
    return (
        E.match_summary(gold, same).withColumn("against", F.lit("itself"))
        .unionByName(E.match_summary(gold, other).withColumn("against", F.lit("receivers")))
    )


@on_transactions(
    "e04_classify_outcome",
    """SELECT if(merchant_category IS NULL, 'ERROR',
                 if(transaction_status = 'FAILED', 'SQL_ERROR', if(fraud_flag = 0, 'PASS', 'FAIL'))) AS status,
              count(*) AS count FROM transactions GROUP BY 1""",
)
def e04_classify_outcome(t: DataFrame) -> DataFrame:
    """The order of precedence, with a row's category, status and flag standing in for a case."""
    status = E.classify_outcome(
        F.col("merchant_category").isNotNull(), F.col("transaction_status") == "SUCCESS", F.col("fraud_flag") == 0
    )
    return t.groupBy(status.alias("status")).agg(rows())


@on_transactions(
    "r01_share_of_total",
    """SELECT network_type AS label, CAST(count(*) AS DOUBLE) AS value,
              round(count(*) * 100e0 / sum(count(*)) OVER (), 1) AS percent FROM transactions GROUP BY 1""",
)
def r01_share_of_total(t: DataFrame) -> DataFrame:
    return R.slices(t.groupBy("network_type").agg(rows()), "network_type", "count")


@register(
    "r02_report_sections",
    """SELECT role AS item, conv_id || '/' || turn AS position,
              CASE role WHEN 'user' THEN 'table' WHEN 'assistant' THEN 'line' ELSE 'kpi' END AS kind,
              CASE role WHEN 'user' THEN 'full_width' WHEN 'assistant' THEN 'grid' ELSE 'kpi' END AS section
       FROM conversations QUALIFY role <> 'user' OR row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) <= 8""",
)
def r02_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per role, with all its messages as rows: a table, a line and a figure."""
    role = F.col("role")
    kind = F.when(role == "user", "table").when(role == "assistant", "line").otherwise("kpi")
    items = messages_of(spark, sf_dir).select(
        role.alias("item"), F.struct("conv_id", "turn").alias("position"), kind.alias("kind")
    )
    return R.report_sections(items).withColumn("position", F.concat_ws("/", "position.conv_id", "position.turn"))


@on_transactions(
    "f16_report_cells",
    """SELECT coalesce(merchant_category, '—') AS merchant_category,
              CASE WHEN n < 1000 THEN CAST(n AS VARCHAR)
                   ELSE (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') END AS payments
       FROM (SELECT merchant_category, count(*) AS n FROM transactions GROUP BY 1)""",
)
def f16_report_cells(t: DataFrame) -> DataFrame:
    return R.as_cells(t.groupBy("merchant_category").agg(rows("payments")))
