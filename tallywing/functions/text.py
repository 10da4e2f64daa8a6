"""Formatting, parsing and fingerprint functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: column names shown with a rupee sign.
MONEY_NAME = re.compile("amount|value|total|sum|credit|debit|inr|revenue|cost", re.IGNORECASE)
DASH = "—"
RUPEE = "₹"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHITESPACE = " \t\n\r\f\v"


def coalesce_number(col: Column) -> Column:
    """The value of a decimal number or its text; anything else counts as 0."""
    text = strip(col.cast("string"))
    return F.coalesce(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(0.0))


def format_inr(col: Column, name: str = "") -> Column:
    """Indian digit grouping (12,34,567) with at most three decimals; a dash for NULL.

    The rupee sign is added when `name` looks like a money column.
    """
    fixed = F.format_string("%.3f", F.abs(col.cast("double")))
    whole = F.substring_index(fixed, ".", 1)
    decimals = F.regexp_replace(F.substring_index(fixed, ".", -1), "0+$", "")
    # A comma wherever three digits, or three plus some pairs, remain to the right.
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    sign = F.when((col < 0) & (F.round(col, 3) != 0), "-").otherwise("")
    money = RUPEE if MONEY_NAME.search(name) else ""
    text = F.concat(
        F.lit(money), sign, grouped, F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise("")
    )
    return F.when(col.isNull(), DASH).otherwise(text)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def truncate_title(text: Column, limit: int = 60) -> Column:
    trimmed = strip(text)
    return F.when(
        F.length(trimmed) > limit, F.concat(F.substring(trimmed, 1, limit), F.lit("..."))
    ).otherwise(trimmed)


def age_bucket(ts: Column, as_of: Column) -> Column:
    """How long before `as_of`: Just now, minutes, hours, days or weeks."""
    minutes = F.floor(F.timestamp_diff("SECOND", ts, as_of) / 60)
    hours, days, weeks = F.floor(minutes / 60), F.floor(minutes / 1440), F.floor(minutes / 10080)

    def tagged(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(unit))

    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, tagged(minutes, "m"))
        .when(hours < 24, tagged(hours, "h"))
        .when(days < 7, tagged(days, "d"))
        .otherwise(tagged(weeks, "w"))
    )


def fingerprint(*parts: Column) -> Column:
    """md5 over length-prefixed parts: equal only when every part is equal."""
    pieces = []
    for p in parts:
        text = F.coalesce(p.cast("string"), F.lit(""))
        pieces += [F.length(text).cast("string"), F.lit(":"), text]
    return F.md5(F.concat(*pieces))


def parse_payload(json: Column, schema: T.StructType) -> Column:
    """Parsed object; malformed or missing text gives an object with every field NULL."""
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return F.coalesce(F.from_json(json, schema), empty)
