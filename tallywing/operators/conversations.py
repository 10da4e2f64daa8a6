"""Conversation-log operators over messages (session, position, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing.functions.text import fingerprint, parse_payload, strip, truncate_title
from tallywing.operators.joins import carry_forward, cascade_delete, null_safe_join
from tallywing.operators.ranking import first_per_group, top

DEFAULT_TITLE = "New chat"
DEFAULT_QUESTION = "Insight"

# The blank-message test and the two roles of a history (fixed values).
USER, ASSISTANT = "user", "assistant"


def sessions_rollup(
    messages: DataFrame, session: str = "conv_id", at: str = "turn", text: str = "text"
) -> DataFrame:
    """One row per session: title from its first user message, first and last activity, size."""
    asked_at = F.when(F.col("role") == USER, F.col(at))
    return messages.groupBy(session).agg(
        # Cut before the aggregation: only the short form is sorted and shuffled.
        F.coalesce(F.min_by(truncate_title(F.col(text)), asked_at), F.lit(DEFAULT_TITLE)).alias("title"),
        F.min(at).alias("created_at"),
        F.max(at).alias("updated_at"),
        F.count("*").alias("messages"),
    )


def list_sessions(sessions: DataFrame, limit: int = 50, session: str = "conv_id") -> DataFrame:
    return top(sessions, limit, F.desc("updated_at"), session)


def session_messages(
    messages: DataFrame, session_id, payload: T.StructType | None = None, session: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """The messages of one session in order; `data_json`, where present, is parsed."""
    own = messages.filter(F.col(session) == F.lit(session_id))
    if payload is not None:
        own = own.withColumn("data", parse_payload(F.col("data_json"), payload)).drop("data_json")
    return own.orderBy(order)


def delete_sessions(
    sessions: DataFrame, messages: DataFrame, deleted: DataFrame, session: str = "conv_id"
) -> tuple[DataFrame, DataFrame]:
    return cascade_delete(sessions, messages, deleted, session)


def non_empty_history(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages with some content; every role but the user's counts as the assistant's."""
    kept = messages.filter(strip(F.col(text)) != "")
    return kept.withColumn("role", F.when(F.col("role") == USER, USER).otherwise(ASSISTANT))


def history_window(
    messages: DataFrame, n: int = 6, session: str = "conv_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """The last n messages of each session as one ordered array."""
    last = first_per_group(messages, [session], n, F.desc(order))
    turns = F.sort_array(F.collect_list(F.struct(F.col(order), F.col("role"), F.col(text).alias("content"))))
    return last.groupBy(session).agg(turns.alias("history"))


def question_answer_pairs(
    messages: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """Each assistant message with the nearest user message before it in its session."""
    asked = F.when(F.col("role") == USER, F.col(text))
    paired = carry_forward(messages, [session], order, asked, "question")
    return paired.filter(F.col("role").isin(ASSISTANT, "ai")).select(
        session, order, F.coalesce("question", F.lit(DEFAULT_QUESTION)).alias("question"), F.col(text).alias("answer")
    )


def request_key(question: Column, history: Column) -> Column:
    """Fingerprint of a question and its history, an array of (order, role, content)."""
    return request_key_of(question, F.transform(history, lambda h: fingerprint(h["role"], h["content"])))


def request_key_of(question: Column, turns: Column) -> Column:
    """The same from the fingerprints (role, content) of the history's turns, in order."""
    return fingerprint(strip(question), F.array_join(turns, ","))


def repeat_hits(requests: DataFrame, keys: list[str], at: str = "ts", ttl_seconds: int = 900) -> DataFrame:
    """Requests with an equal one at most `ttl_seconds` earlier, flagged in `hit`.

    Time is cut into stretches one TTL long. The latest earlier request within the
    TTL lies in the same stretch or the one before, so a busy key is spread over
    its stretches and each needs only the last time of its predecessor.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cut = requests.withColumn("__slot", F.floor(micros / F.lit(ttl_seconds * 1_000_000)))
    w = W.partitionBy(*keys, "__slot").orderBy(at)
    local = cut.withColumn("__prev", F.lag(at).over(w))
    ends = cut.groupBy(*keys, (F.col("__slot") + 1).alias("__slot")).agg(F.max(at).alias("__carried"))
    joined = null_safe_join(local, ends, [*keys, "__slot"])
    previous = F.coalesce("__prev", "__carried")
    gap = micros - F.unix_micros(previous.cast("timestamp"))
    return joined.withColumn(
        "hit", F.coalesce(gap <= ttl_seconds * 1_000_000, F.lit(False))
    ).drop("__slot", "__prev", "__carried")


def repeat_share(requests: DataFrame, keys: list[str], at: str = "ts", ttl_seconds: int = 900) -> DataFrame:
    hits = repeat_hits(requests, keys, at, ttl_seconds)
    return hits.agg(
        F.count("*").alias("requests"),
        F.count_if("hit").alias("hits"),
        F.try_divide(F.count_if("hit") * F.lit(100.0), F.count("*")).alias("hit_rate"),
    )
