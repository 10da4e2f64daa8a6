"""Rates, shares, medians, running totals and one-scan multi-dimension aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def failed() -> Column:
    return F.col("transaction_status") == "FAILED"


def succeeded() -> Column:
    return F.col("transaction_status") == "SUCCESS"


def rate(condition: Column) -> Column:
    """Percentage of rows meeting a condition; NULL when there are no rows."""
    return F.try_divide(F.count_if(condition) * F.lit(100.0), F.count("*"))


def flag_rate(flag: str = "fraud_flag") -> Column:
    """Percentage for a 0/1 column."""
    return F.try_divide(F.sum(flag) * F.lit(100.0), F.count("*"))


def grand_total(df: DataFrame, column: str) -> Column:
    """The sum of a column as a scalar subquery: one value, no window over all rows."""
    return df.agg(F.sum(column)).scalar()


def share_of_total(df: DataFrame, column: str, name: str = "percentage") -> DataFrame:
    """Percentage each row contributes to the column's grand total."""
    return df.withColumn(name, F.try_divide(F.col(column) * F.lit(100.0), grand_total(df, column)))


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first; NULL is left out."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias(name))
        .orderBy(F.desc(name), column)
    )


def value_counts_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """`value_counts` of several text columns in one scan: (column, value, count).

    The columns are counted together first, so the frame that is unfolded to one
    row per column holds at most one row per combination of values.
    """
    combos = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return (
        combos.select(F.explode(pairs).alias("p"), "__n")
        .select("p.column", "p.value", "__n")
        .filter("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.sum("__n").alias("count"))
    )


def running_totals(hist: DataFrame, value: str, amount: str, widths: list[float], name: str = "before") -> DataFrame:
    """For each distinct `value`, the total of `amount` over all smaller values.

    `hist` holds one row per value. Values are binned by the falling `widths`, each
    a part of the one before. The totals of the widest bins are few and are summed
    up in one window; every further level is summed up inside the bins of the level
    above and starts from their total, so no window sorts more than one bin. The
    values themselves meet only the totals of the narrowest bins, by which their
    window has already arranged them.
    """
    bins = [f"__bin{i}" for i in range(len(widths))]
    # Bins that cannot be NULL: the joins then add no filter of their own below the
    # shuffle, and all levels share the one that builds `hist`.
    cut = hist.withColumns({
        b: F.coalesce(F.floor(F.col(value) / F.lit(w)), F.lit(-1)) for b, w in zip(bins, widths)
    })

    def preceding(column: str, by: list[str], order: str) -> Column:
        w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(w), F.lit(0))

    offsets = None
    for i, b in enumerate(bins):
        totals = cut.groupBy(*bins[: i + 1]).agg(F.sum(amount).alias("__total"))
        start = totals.withColumn("__start", preceding("__total", bins[:i], b)).drop("__total")
        if offsets is not None:
            above = offsets.withColumnRenamed("__start", "__above")
            start = start.join(above, bins[:i]).withColumn("__start", F.col("__start") + F.col("__above")).drop("__above")
        offsets = start
    inside = cut.withColumn("__inside", preceding(amount, bins, value))
    return inside.join(offsets, bins).select(*hist.columns, (F.col("__start") + F.col("__inside")).alias(name))


def upper_median(df: DataFrame, column: str, name: str = "median") -> DataFrame:
    """The value at 0-based position count/2 of the sorted whole-number column.

    Counts per value, not rows, are sorted; a window sorts at most 65,536 of them.
    """
    hist = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = hist.agg(F.sum("n")).scalar()
    placed = running_totals(hist, column, "n", [65536])
    target = F.floor(total / F.lit(2))
    return placed.filter((F.col("before") <= target) & (F.col("before") + F.col("n") > target)).select(
        F.col(column).alias(name)
    )


def overall_and_by(df: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """One aggregate overall and once per dimension from a single scan.

    `dimension` names the grouped column, or `overall`; a NULL key of a dimension
    stays apart from the overall row.
    """
    sets = [[]] + [[d] for d in dimensions]
    grouped = df.groupingSets(
        [[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dimensions]
    ).agg(*[m.alias(n) for n, m in measures.items()], F.grouping_id().alias("__gid"))
    full = (1 << len(dimensions)) - 1
    kind, key = F.lit("overall"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("__gid") == (full ^ (1 << (len(dimensions) - 1 - i)))
        kind = F.when(here, d).otherwise(kind)
        key = F.when(here, F.col(d).cast("string")).otherwise(key)
    return grouped.select(kind.alias("dimension"), key.alias("key"), *measures)


def count_by_status(df: DataFrame, key: str, status: str, statuses: list[str]) -> DataFrame:
    """One column per status with its number of rows for each key."""
    return df.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses])
