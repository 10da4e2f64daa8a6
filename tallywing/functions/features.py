"""Feature derivation: buckets, labels, keys and the rule-based risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing import schema as S


def pick(values: list[str], index: Column) -> Column:
    """The value at a 0-based position of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def day_part(hour: Column, variant: str = "stored") -> Column:
    morning, afternoon, evening, night = S.DAY_PART_STARTS[variant]
    return (
        F.when(hour.isNull(), None)
        .when((hour >= morning) & (hour < afternoon), "Morning")
        .when((hour >= afternoon) & (hour < evening), "Afternoon")
        .when((hour >= evening) & (hour < night), "Evening")
        .otherwise("Night")
    )


def amount_tier(amount: Column, label_style: str = "short") -> Column:
    label = S.AMOUNT_TIER_LABELS[label_style]
    return (
        F.when(amount < 500, label["Small"])
        .when(amount <= 5000, label["Medium"])
        .when(amount <= 50000, label["Large"])
        .when(amount > 50000, label["Very Large"])
    )


def age_label(group: Column, label_style: str = "short") -> Column:
    """Young / Adult / Old; an unknown bracket gives NULL."""
    label = S.AGE_LABELS[label_style]
    out = None
    for name in ("Young", "Adult", "Old"):
        members = [g for g, v in S.AGE_GROUP_TO_LABEL.items() if v == name]
        hit = group.isin(members)
        out = F.when(hit, label[name]) if out is None else out.when(hit, label[name])
    return out


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def day_name(ts: Column) -> Column:
    return pick(S.WEEKDAYS, F.weekday(ts))


def with_calendar_columns(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({
        "hour_of_day": F.hour(ts).cast("int"),
        "day_of_week": day_name(F.col(ts)),
        "is_weekend": is_weekend(F.col(ts)),
    })


def transaction_key(n: Column) -> Column:
    return F.concat(F.lit("TXN"), F.lpad(n.cast("string"), 10, "0"))


def risk_permille(
    amount: Column, hour: Column, network: Column, device: Column, weekend: Column, kind: Column
) -> Column:
    """Additive fraud likelihood in thousandths; whole numbers keep every engine exact."""

    def add(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    total = (
        F.lit(20)
        + F.when(amount > 20000, 80).when(amount > 10000, 40).otherwise(0)
        + add((hour < 5) | (hour > 22), 50)
        + add(network == "3G", 30)
        + add(device == "Web", 20)
        + add(weekend == 1, 10)
        + add((kind == "P2P") & (amount > 15000), 30)
    )
    return F.least(total, F.lit(300))


def row_risk_permille() -> Column:
    """`risk_permille` over the stored column names."""
    return risk_permille(
        F.col("amount_inr"), F.col("hour_of_day"), F.col("network_type"),
        F.col("device_type"), F.col("is_weekend"), F.col("transaction_type"),
    )


def rule_risk_score(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_score", row_risk_permille() / F.lit(1000.0))


def null_if_not_applicable(df: DataFrame) -> DataFrame:
    """Category only for merchant payments, receiver age only for P2P."""
    p2p = F.col("transaction_type") == "P2P"
    fixes = {"merchant_category": F.when(~p2p, F.col("merchant_category"))}
    for c in ("receiver_age_group", "receiver_age_label"):
        if c in df.columns:
            fixes[c] = F.when(p2p, F.col(c))
    return df.withColumns(fixes)


def with_derived_labels(df: DataFrame, variant: str = "stored", label_style: str = "short") -> DataFrame:
    """The four label columns the raw file lacks."""
    return df.withColumns({
        "day_part": day_part(F.col("hour_of_day"), variant),
        "amount_tier": amount_tier(F.col("amount_inr"), label_style),
        "sender_age_label": age_label(F.col("sender_age_group"), label_style),
        "receiver_age_label": age_label(F.col("receiver_age_group"), label_style),
    })


def bank_routing(sender: Column, receiver: Column) -> Column:
    return F.when(sender != receiver, "Cross-Bank").otherwise("Same-Bank")


def risk_category(flag: Column, amount: Column) -> Column:
    return (
        F.when((flag == 1) & (amount > 5000), "High Risk")
        .when(flag == 1, "Medium Risk")
        .otherwise("Low Risk")
    )


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability < 0.3, "Low").when(probability < 0.7, "Medium").when(probability.isNotNull(), "High")
    )


def verdict(probability: Column) -> Column:
    return F.when(probability >= 0.5, "FRAUD").when(probability.isNotNull(), "LEGITIMATE")


def period_label(weekend: Column) -> Column:
    return F.when(weekend == 1, "Weekend").otherwise("Weekday")


def peak_label(count: Column, total: Column) -> Column:
    """Peak when above the whole-number hourly average of `total`."""
    return F.when(count > F.floor(total / F.lit(24)), "Peak").otherwise("Off-Peak")


def fill_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna({c: "Unknown" for c in columns})
