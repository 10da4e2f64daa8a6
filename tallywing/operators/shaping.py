"""Shaping results for reports: slices, sections and text cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing.functions.text import DASH, coalesce_number, format_inr
from tallywing.operators.aggregates import share_of_total
from tallywing.operators.ranking import first_per_group

# Which report section each kind of item belongs to (fixed values).
SECTIONS = {"kpi": "kpi", "pie": "grid", "line": "grid", "bar": "full_width", "table": "full_width"}
TABLE_ROWS = 8


def slices(df: DataFrame, label: str, value: str) -> DataFrame:
    """Label, numeric value and percentage of the whole with one decimal."""
    numbers = df.select(F.col(label).alias("label"), coalesce_number(F.col(value)).alias("value"))
    return share_of_total(numbers, "value", "percent").withColumn("percent", F.round("percent", 1))


def report_sections(items: DataFrame, item: str = "item", kind: str = "kind", order: str = "position") -> DataFrame:
    """Rows of report items with their section; a table shows its first rows only.

    Items of any other kind have no section and are left out.
    """
    section = F.lit(None).cast("string")
    for k, s in SECTIONS.items():
        section = F.when(F.col(kind) == k, s).otherwise(section)
    placed = items.withColumn("section", section).filter(F.col("section").isNotNull())
    tables = first_per_group(placed.filter(F.col(kind) == "table"), [item], TABLE_ROWS, order)
    return placed.filter(F.col(kind) != "table").unionByName(tables.drop("rank"))


def as_cells(df: DataFrame) -> DataFrame:
    """Every value as display text: grouped numbers, a dash for NULL."""
    numeric = (T.NumericType,)
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, numeric):
            cells.append(format_inr(c, f.name).alias(f.name))
        else:
            cells.append(F.coalesce(c.cast("string"), F.lit(DASH)).alias(f.name))
    return df.select(*cells)
