"""Data-quality rules; each gives one row per rule with the number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions import features as X


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules in one scan: (rule, violations)."""
    counted = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]
    return counted.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def outside(column: str, allowed: list[str]) -> Column:
    """A value that is present but not in the list."""
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def domain_rules(domains: dict[str, list[str]] | None = None) -> dict[str, Column]:
    return {f"{c} in domain": outside(c, v) for c, v in (domains or S.DOMAINS).items()}


def domain_violations(df: DataFrame, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """How often each unlisted value occurs: (column, value, count).

    A row contributes only its offending values, so clean rows cost no shuffle.
    """
    found = F.array(
        *[
            F.when(outside(c, v), F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))
            for c, v in (domains or S.DOMAINS).items()
        ]
    )
    return (
        df.select(F.explode(F.array_compact(found)).alias("v"))
        .groupBy("v.column", "v.value")
        .agg(F.count("*").alias("count"))
    )


def category_rules() -> dict[str, Column]:
    p2p, has = F.col("transaction_type") == "P2P", F.col("merchant_category").isNotNull()
    return {"P2P has no category": p2p & has, "others have a category": ~p2p & ~has}


def receiver_rules() -> dict[str, Column]:
    p2p = F.col("transaction_type") == "P2P"
    rules = {}
    for c in ("receiver_age_group", "receiver_age_label"):
        rules[f"P2P has {c}"] = p2p & F.col(c).isNull()
        rules[f"others have no {c}"] = ~p2p & F.col(c).isNotNull()
    return rules


def range_rules() -> dict[str, Column]:
    return {
        "hour_of_day in 0..23": ~F.col("hour_of_day").between(0, 23),
        "is_weekend is 0 or 1": ~F.col("is_weekend").isin(0, 1),
        "fraud_flag is 0 or 1": ~F.col("fraud_flag").isin(0, 1),
        "amount_inr not negative": F.col("amount_inr") < 0,
    }


def derivation_rules(variant: str = "stored", label_style: str = "short") -> dict[str, Column]:
    """Stored derived columns against their recomputed values; NULL equals NULL."""
    expected = {
        "hour_of_day": F.hour("timestamp"),
        "day_of_week": X.day_name(F.col("timestamp")),
        "is_weekend": X.is_weekend(F.col("timestamp")),
        "day_part": X.day_part(F.col("hour_of_day"), variant),
        "amount_tier": X.amount_tier(F.col("amount_inr"), label_style),
        "sender_age_label": X.age_label(F.col("sender_age_group"), label_style),
        "receiver_age_label": X.age_label(F.col("receiver_age_group"), label_style),
    }
    return {f"{c} as derived": ~F.col(c).eqNullSafe(v) for c, v in expected.items()}


def malformed_id(column: str = "transaction_id") -> Column:
    return ~F.coalesce(F.col(column).rlike("^TXN[0-9]{10}$"), F.lit(False))


def key_checks(df: DataFrame, column: str = "transaction_id") -> DataFrame:
    """Keys used more than once and malformed keys, from one grouping by key."""
    keys = df.groupBy(column).agg(F.count("*").alias("n"))
    return count_violations(
        keys.withColumn("bad", malformed_id(column)),
        {f"{column} unique": F.col("n") > 1, f"{column} well formed": F.col("bad")},
    )


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Rows, NULLs and distinct values per column, in one scan.

    Distinct counts are approximate unless `exact`; exact counting suits columns
    with few values.
    """
    columns = columns or df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    counted = df.agg(
        F.count("*").alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in columns],
        *[distinct(c).alias(f"__distinct_{c}") for c in columns],
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("__rows").alias("rows"),
            F.col(f"__null_{c}").alias("nulls"),
            F.col(f"__distinct_{c}").alias("distinct_values"),
        )
        for c in columns
    ]
    return counted.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


# Registers of a distinct-count sketch, as a power of two, and three standard errors of its estimates.
SKETCH_SIZE = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_SIZE / 2)


def day_sketches(df: DataFrame, columns: list[str] | None = None, at: str = "timestamp") -> DataFrame:
    """(day, column, rows, nulls, sketch): what a profile of any days needs, in one scan.

    Stored sketches of days never change when further days are added, and `profile_days` puts them together.
    Rows without a time have the day NULL.
    """
    columns = columns or df.columns
    daily = df.groupBy(F.to_date(at).alias("__day")).agg(
        F.count("*").alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in columns],
        *[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_SIZE).alias(f"__sketch_{c}") for c in columns],
    )
    figures = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("__rows").alias("rows"),
            F.col(f"__null_{c}").alias("nulls"),
            F.col(f"__sketch_{c}").alias("sketch"),
        )
        for c in columns
    ]
    return daily.select(F.col("__day").alias("day"), F.explode(F.array(*figures)).alias("f")).select("day", "f.*")


def profile_days(sketches: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """`profile` of the days from `first` to `last`, both included, or of all rows, from `day_sketches` alone.

    Rows and NULLs are exact; `distinct_values` is within SKETCH_ERROR of the exact count in all but a few of a thousand cases.
    """
    for limit, holds in ((first, F.col("day") >= F.lit(first).cast("date")), (last, F.col("day") <= F.lit(last).cast("date"))):
        sketches = sketches.filter(holds) if limit else sketches
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
    )
