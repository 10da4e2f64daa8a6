"""File sources and sinks: raw CSV, enriched tables, reports and query access by SQL text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing import schema as S
from tallywing.functions import dates as D
from tallywing.functions import features as X


REASON_COLUMN = "_reason"


def _known_field(name: str) -> T.StructField:
    known = {f.name: f for f in [*S.RAW_CSV.fields, *S.TRANSACTIONS.fields]}
    return known.get(name, T.StructField(name, T.StringType()))


def _typed(text: Column, kind: T.DataType) -> Column:
    """The value of a field's text, NULL where it isn't one."""
    if isinstance(kind, T.StringType):
        return text
    value = text.try_cast(kind)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), value)
    return value


def parse_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the raw file: its fields with known types, `_corrupt_record` and `_reason`.

    Only the header is looked at beforehand; nothing is inferred. All fields are split as text first and turned into
    their types by expressions, so whether a line fits doesn't depend on the columns that are read later: it does if it
    has as many fields as the header and no field has text that is not of its type. Of other lines `_corrupt_record`
    has the text and `_reason` what is wrong, `field count` or the names of the faulty columns. Blank lines and the
    header of each file are no lines. A field may not hold a line end.
    """
    names = spark.read.option("header", True).csv(path).columns
    places = [f"c{i}" for i in range(len(names))]
    layout = ", ".join(f"{c} string" for c in [*places, S.CORRUPT_COLUMN])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT_COLUMN}
    lines = spark.read.text(path).where("trim(value) != ''").select("value", F.from_csv("value", layout, options).alias("r"))
    header = F.lit(True)
    for c, name in zip(places, names, strict=True):
        header &= F.col(f"r.{c}").eqNullSafe(F.lit(name))
    fields, faults = [], []
    for c, name in zip(places, names, strict=True):
        text, kind = F.col(f"r.{c}"), _known_field(name).dataType
        value = _typed(text, kind)
        fields.append(value.alias(name))
        if not isinstance(kind, T.StringType):
            faults.append(F.when(text.isNotNull() & (F.trim(text) != "") & value.isNull(), F.lit(name)))
    wrong = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")
    reason = F.when(F.col(f"r.{S.CORRUPT_COLUMN}").isNotNull(), F.lit("field count")).when(F.size(wrong) > 0, F.array_join(wrong, ", "))
    return lines.where(~header).select(
        *fields, F.when(reason.isNotNull(), F.col("value")).alias(S.CORRUPT_COLUMN), reason.alias(REASON_COLUMN)
    )


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw file with known types, in the file's own column order.

    Lines that do not fit are kept with their text in `_corrupt_record`.
    """
    return parse_lines(spark, path).drop(REASON_COLUMN)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, reason) of every line that `load_raw` leaves out."""
    bad = parse_lines(spark, path).where(F.col(REASON_COLUMN).isNotNull())
    return bad.select(F.col(S.CORRUPT_COLUMN).alias("line"), F.col(REASON_COLUMN).alias("reason"))


def rename_source_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(S.SOURCE_RENAMES)


def load_raw(spark: SparkSession, path: str, variant: str = "stored", label_style: str = "short") -> DataFrame:
    """Raw CSV to the enriched 21-column table; the lines of `rejected_lines` are left out, whichever columns are read."""
    raw = rename_source_columns(read_transactions_csv(spark, path))
    fit = raw.filter(F.col(S.CORRUPT_COLUMN).isNull()).drop(S.CORRUPT_COLUMN)
    return X.with_derived_labels(fit, variant, label_style).select(*S.TRANSACTION_COLUMNS)


def write_table_replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table_files(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; times as `yyyy-MM-dd HH:mm:ss`."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_raw_csv(df: DataFrame, path: str) -> None:
    """The stored columns under the raw file's headers, without the derived labels."""
    names = {v: k for k, v in S.SOURCE_RENAMES.items()}
    write_csv(df.drop(*S.DERIVED_LABELS).withColumnsRenamed(names), path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One JSON object per row, NULL fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cluster_for_access(df: DataFrame, path: str, sort_by: tuple[str, ...] = ("sender_bank", "timestamp")) -> None:
    """Write one folder per day, sorted inside, so that day and bank filters skip files and row groups.

    `rebalance` brings a day's rows together but lets the adaptive planner split a
    day that is far larger than the others.
    """
    daily = df.withColumn("txn_date", F.to_date("timestamp"))
    (
        daily.hint("rebalance", "txn_date")
        .sortWithinPartitions("txn_date", *sort_by)
        .write.mode("overwrite")
        .partitionBy("txn_date")
        .parquet(path)
    )


def between_days(clustered: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """Rows of a clustered table from `first` to `last`, both included; reads only their folders."""
    day = F.col("txn_date")
    return clustered.filter((day >= F.lit(str(first)).cast("date")) & (day <= F.lit(str(last)).cast("date")))


def _order_number(df: DataFrame, column: str) -> Column:
    """A number that keeps the order of a column: the first seven bytes of a text, the time of day of a time."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        digits = F.rpad(F.substring(F.hex(F.substring(c, 1, 7)), 1, 14), 14, "0")
        return F.conv(digits, 16, 10).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) - F.unix_micros(F.date_trunc("day", c).cast("timestamp"))
    return c.cast("double")


# Steps per column on the curve, a power of two.
CURVE_STEPS = 16


def curve_place(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The place of a row on a space-filling (Z-order) curve over these columns, NULL first.

    A column's step is the share of its cuts, its quantiles in all rows, that lie below the value; a column of few values has
    fewer cuts and its steps are spread, so that its first bit tells most. One aggregate finds all cuts, a fixed number.
    """
    quantiles = F.array(*[F.lit(i / CURVE_STEPS) for i in range(1, CURVE_STEPS)])
    found = df.agg(*[F.percentile_approx(_order_number(df, c), quantiles, 1000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    steps = []
    for c, at in zip(columns, found):
        cuts = sorted(set(at or []))
        below = [F.when(_order_number(df, c) > F.lit(cut), 1).otherwise(0) for cut in cuts]
        step = sum(below, F.lit(0)) * CURVE_STEPS
        steps.append(F.floor(step / F.lit(len(cuts) + 1)).cast("int"))
    place = F.lit(0)
    for bit in reversed(range(CURVE_STEPS.bit_length() - 1)):
        for step in steps:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(step, bit).bitwiseAND(F.lit(1)))
    return place


def write_for_lookup(
    df: DataFrame,
    path: str,
    ids: tuple[str, ...] = ("transaction_id",),
    columns: tuple[str, ...] = ("sender_bank", "hour_of_day", "fraud_flag"),
    row_group_bytes: int = 32 << 20,
) -> None:
    """Write one folder per day so that lookups by id, and filters on any of `columns`, skip most of what is stored.

    Rows of a day lie along a curve over `columns`: every row group and page holds a small range of each. The time of day is
    taken by its hour, because filters on times without a zone don't reach the files. Ids get Bloom
    filters, one a row group. Days and places are dealt to tasks by range, equal places by a hash of the id, so that a large
    day or a frequent combination becomes several files and a small day one.
    """
    placed = df.withColumns({"txn_date": F.to_date("timestamp"), "__place": curve_place(df, columns)})
    options = {"parquet.block.size": row_group_bytes, "parquet.bloom.filter.adaptive.enabled": "true"}
    for c in ids:
        # A dictionary of ids would be as long as the column and leave no Bloom filter.
        options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.enable.dictionary#{c}": "false"}
    (
        placed.repartitionByRange("txn_date", "__place", F.xxhash64(*ids))
        .sortWithinPartitions("txn_date", "__place", *columns)
        .drop("__place")
        .write.mode("overwrite")
        .options(**options)
        .partitionBy("txn_date")
        .parquet(path)
    )


# Date pattern tokens of the text queries and their Spark spelling (fixed values).
PATTERN_TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def register_sql(spark: SparkSession, t: DataFrame, view: str = "transactions") -> None:
    """Expose the transactions and the row functions to SQL text.

    Times are text in the view, so that `substr(timestamp, 6, 2)`, `date(timestamp)`
    and `strftime('%Y-%m', timestamp)` work as they do on the stored table.
    """
    t.withColumn("timestamp", D.iso_text(F.col("timestamp"))).createOrReplaceTempView(view)
    morning, afternoon, evening, night = S.DAY_PART_STARTS["stored"]
    pattern = "f"
    for token, spelling in PATTERN_TOKENS.items():
        pattern = f"replace({pattern}, '{token}', '{spelling}')"
    young, adult, old = (
        ", ".join(f"'{g}'" for g, v in S.AGE_GROUP_TO_LABEL.items() if v == label)
        for label in ("Young", "Adult", "Old")
    )
    functions = {
        "strftime(f STRING, t STRING)": f"date_format(CAST(t AS TIMESTAMP), {pattern})",
        "day_part_of(h INT)": (
            f"CASE WHEN h IS NULL THEN NULL WHEN h >= {morning} AND h < {afternoon} THEN 'Morning' "
            f"WHEN h >= {afternoon} AND h < {evening} THEN 'Afternoon' "
            f"WHEN h >= {evening} AND h < {night} THEN 'Evening' ELSE 'Night' END"
        ),
        "amount_tier_of(a BIGINT)": (
            "CASE WHEN a < 500 THEN 'Small' WHEN a <= 5000 THEN 'Medium' "
            "WHEN a <= 50000 THEN 'Large' WHEN a > 50000 THEN 'Very Large' END"
        ),
        "age_label_of(g STRING)": (
            f"CASE WHEN g IN ({young}) THEN 'Young' WHEN g IN ({adult}) THEN 'Adult' WHEN g IN ({old}) THEN 'Old' END"
        ),
        "bank_routing_of(s STRING, r STRING)": "CASE WHEN s <> r THEN 'Cross-Bank' ELSE 'Same-Bank' END",
        "risk_level_of(p DOUBLE)": (
            "CASE WHEN p < 0.3D THEN 'Low' WHEN p < 0.7D THEN 'Medium' WHEN p IS NOT NULL THEN 'High' END"
        ),
    }
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")


def read_query(spark: SparkSession, text: str, **args) -> DataFrame:
    """Run SQL text over the registered views; `:name` markers take their values from `args`."""
    return spark.sql(text, args=args or None)
