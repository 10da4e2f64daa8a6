"""Forecasting operators over the daily order and transaction series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.operators import forecast as P
from tallywing.plans.registry import on_transactions, register
from tallywing.session import scratch_path
from tallywing.sources.fixture import table

METRICS = ["txn_count", "total_amount"]


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their value per day; some days have none."""
    metrics = {"txn_count": F.count("*"), "total_amount": F.round(F.sum("o_totalprice"), 2)}
    return P.daily_series(table(spark, sf_dir, "orders"), metrics, "o_orderdate")


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every day of the calendar."""
    return P.fill_calendar(order_days(spark, sf_dir), METRICS)


def stored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: fitting reads a row per day several times, not the table."""
    path = scratch_path(spark, "series")
    series = order_series(spark, sf_dir)
    series.write.parquet(path)
    return spark.read.schema(series.schema).parquet(path)


def as_text(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Days as text and the given numbers rounded."""
    out = {c: F.round(c, digits) for c in columns}
    return df.withColumns({"ds": F.col("ds").cast("string"), **out})


ORDERS_SQL = """days AS (SELECT CAST(o_orderdate AS DATE) AS ds, count(*) AS txn_count,
    round(sum(o_totalprice), 2) AS total_amount FROM orders GROUP BY 1),
  series AS (SELECT c.ds, coalesce(txn_count, 0) AS txn_count, coalesce(total_amount, 0) AS total_amount
    FROM (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM days) c
    LEFT JOIN days USING (ds))"""

BASELINE_SQL = f"""{ORDERS_SQL},
  pts AS (SELECT CAST(ds - DATE '1970-01-01' AS DOUBLE) AS x, CAST(txn_count AS DOUBLE) AS y, isodow(ds) AS w FROM series),
  line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pts),
  tr AS (SELECT pts.*, a + b * x AS trend FROM pts, line),
  idx AS (SELECT w, sum(y) / sum(trend) AS i FROM tr GROUP BY 1),
  err AS (SELECT stddev_samp(y - trend * i) AS sd FROM tr JOIN idx USING (w)),
  ahead AS (SELECT CAST(unnest(generate_series(max(ds) + INTERVAL 1 DAY, max(ds) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS DATE) AS ds
            FROM series),
  f AS (SELECT ds, (a + b * (ds - DATE '1970-01-01')) * i AS yhat, sd * {P.NORMAL_90} AS half
        FROM ahead JOIN idx ON w = isodow(ds), line, err),
  forecast AS (SELECT ds, yhat, yhat - half AS yhat_lower, yhat + half AS yhat_upper FROM f)"""

_ROUNDED = "CAST(ds AS VARCHAR) AS ds, round(yhat, 4) AS yhat, round(yhat_lower, 4) AS yhat_lower, round(yhat_upper, 4) AS yhat_upper"


@on_transactions(
    "ts01_daily_series",
    """SELECT sender_bank, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS ds, count(*) AS txn_count,
              CAST(sum(amount_inr) AS BIGINT) AS total_amount FROM transactions GROUP BY 1, 2""",
)
def ts01_daily_series(t: DataFrame) -> DataFrame:
    metrics = {"txn_count": F.count("*"), "total_amount": F.sum("amount_inr")}
    return as_text(P.daily_series(t, metrics, by=["sender_bank"]))


@register(
    "ts02_fill_calendar",
    f"WITH {ORDERS_SQL} SELECT CAST(ds AS VARCHAR) AS ds, txn_count, round(total_amount, 2) AS total_amount FROM series",
)
def ts02_fill_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(order_series(spark, sf_dir), "total_amount", digits=2)


@register(
    "ts03_fourier_features",
    f"WITH {ORDERS_SQL} SELECT CAST(ds AS VARCHAR) AS ds, "
    + ", ".join(
        f"round({f}((ds - DATE '1970-01-01') * 2 * pi() * {k} / {p}), 6) AS {n}_{f}_{k}"
        for n, p, order in (("yearly", "365.25e0", 10), ("weekly", "7e0", 3))
        for k in range(1, order + 1)
        for f in ("sin", "cos")
    )
    + " FROM series",
)
def ts03_fourier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {n: F.round(c, 6) for n, c in P.fourier_features(F.col("ds")).items()}
    days = order_series(spark, sf_dir).select("ds", *[c.alias(n) for n, c in cols.items()])
    return as_text(days)


@register(
    "ts04_trend_features",
    f"""WITH {ORDERS_SQL}, s AS (SELECT ds, (ds - (SELECT min(ds) FROM series)) * 1e0
          / ((SELECT max(ds) FROM series) - (SELECT min(ds) FROM series)) AS u FROM series)
        SELECT CAST(ds AS VARCHAR) AS ds, round(u, 6) AS slope, """
    + ", ".join(f"round(greatest(0e0, u - 0.8e0 * {j} / 25), 6) AS bend_{j}" for j in range(1, 26))
    + " FROM s",
)
def ts04_trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = order_series(spark, sf_dir)
    x = P.day_number(F.col("ds"))
    first, last = series.agg(F.min(x)).scalar(), series.agg(F.max(x)).scalar()
    timed = series.select("ds", ((x - first) / (last - first)).alias("u"))
    cols = P.trend_features(F.col("u"))
    return as_text(timed.select("ds", *[F.round(c, 6).alias(n) for n, c in cols.items()]))


@register("ts05_fit_forecast")
def ts05_fit_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the fitted model follows the history of both targets."""
    series = stored_series(spark, sf_dir)
    parts = []
    for target in METRICS:
        fitted = P.fit_forecast(series, target).predict(series)
        error = F.abs(F.col("yhat") - F.col(target))
        parts.append(
            fitted.agg(
                F.lit(target).alias("target"),
                F.count("*").alias("days"),
                F.round(F.sum(error) / F.sum(target) * 100, 2).alias("error_pct"),
                F.round(F.avg((F.col(target).between(F.col("yhat_lower"), F.col("yhat_upper"))).cast("int")), 2).alias(
                    "in_band"
                ),
            )
        )
    return parts[0].unionByName(parts[1])


@on_transactions("ts05_forecast_each", state=True)
def ts05_forecast_each(t: DataFrame) -> DataFrame:
    """A forecast of the daily count for every state."""
    daily = P.daily_series(t, {"txn_count": F.count("*")}, by=["sender_state"])
    filled = P.fill_calendar(daily, ["txn_count"], ["sender_state"])
    return as_text(P.forecast_each(filled, ["sender_state"], "txn_count"), *P.BOUNDS)


@register(
    "ts06_future_frame",
    """SELECT o_orderpriority, strftime(max(CAST(o_orderdate AS DATE)) + CAST(d AS INTEGER), '%Y-%m-%d') AS ds
       FROM orders, range(1, 91) r(d) GROUP BY 1, d""",
)
def ts06_future_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days ahead per order priority; a year is cut to the longest horizon."""
    orders = table(spark, sf_dir, "orders")
    daily = P.daily_series(orders, {"n": F.count("*")}, "o_orderdate", ["o_orderpriority"])
    return as_text(P.future_frame(daily, 365, ["o_orderpriority"]))


@register("ts07_predict")
def ts07_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(P.forecast_response(stored_series(spark, sf_dir), "count", 30), *P.BOUNDS)


@register("ts07_predict_amount")
def ts07_predict_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(P.forecast_response(stored_series(spark, sf_dir), "amount", 60), *P.BOUNDS, digits=2)


@register(
    "s10_save_load_forecast",
    f"WITH {ORDERS_SQL} SELECT target, count(*) AS days, 0 AS different FROM series, (VALUES ('txn_count'), ('total_amount')) v(target) GROUP BY 1",
)
def s10_save_load_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the history on which a saved and loaded model says something else than the fitted one."""
    series, parts = stored_series(spark, sf_dir), []
    for target in METRICS:
        model, path = P.fit_forecast(series, target), scratch_path(spark, "forecast")
        model.save(spark, path)
        again = P.Forecaster.load(spark, path).predict(series).select("ds", F.struct(*P.BOUNDS).alias("b"))
        both = model.predict(series).select("ds", F.struct(*P.BOUNDS).alias("a")).join(again, "ds", "full")
        different = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
        parts.append(both.agg(F.lit(target).alias("target"), F.count("*").alias("days"), different.alias("different")))
    return parts[0].unionByName(parts[1])


@register(
    "ts08_what_if",
    f"""WITH {BASELINE_SQL} SELECT CAST(ds AS VARCHAR) AS ds, round(yhat * 1.15e0, 4) AS yhat,
        round(yhat_lower * 1.15e0, 4) AS yhat_lower, round(yhat_upper * 1.15e0, 4) AS yhat_upper FROM forecast""",
)
def ts08_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(P.what_if(P.baseline_forecast(order_series(spark, sf_dir), "txn_count"), 1.15), *P.BOUNDS)


@register(
    "ts09_forecast_metadata",
    f"""WITH {ORDERS_SQL} SELECT 30 AS forecast_days, count(*) AS training_days, CAST(min(ds) AS VARCHAR) AS range_start,
        CAST(max(ds) AS VARCHAR) AS range_end, round_even(avg(txn_count), 0) AS avg_daily_count,
        round_even(avg(total_amount), 0) AS avg_daily_amount,
        CAST(floor(round_even(avg(total_amount), 0) * 0.9e0 + 0.5e0) AS BIGINT) AS scenario_daily_amount FROM series""",
)
def ts09_forecast_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forecast_metadata(order_series(spark, sf_dir), 30, factor=0.9)


@register(
    "ts10_history_plus_forecast",
    f"""WITH {BASELINE_SQL} SELECT CAST(ds AS VARCHAR) AS date, 'forecast' AS type, NULL AS actual,
               CAST(floor(yhat + 0.5) AS BIGINT) AS predicted, CAST(floor(yhat_lower + 0.5) AS BIGINT) AS lower,
               CAST(floor(yhat_upper + 0.5) AS BIGINT) AS upper FROM forecast
        UNION ALL SELECT CAST(ds AS VARCHAR), 'historical', txn_count, NULL, NULL, NULL
        FROM (SELECT * FROM series ORDER BY ds DESC LIMIT 30)""",
)
def ts10_history_plus_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = order_series(spark, sf_dir)
    joined = P.history_plus_forecast(series, "txn_count", P.baseline_forecast(series, "txn_count"))
    return joined.withColumn("date", F.col("date").cast("string"))


@register(
    "ts11_forecast_summary",
    f"""WITH {BASELINE_SQL} SELECT count(*) AS days, round(avg(yhat), 4) AS avg_yhat,
        round(avg(yhat_lower), 4) AS avg_yhat_lower, round(avg(yhat_upper), 4) AS avg_yhat_upper FROM forecast""",
)
def ts11_forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = P.forecast_summary(P.baseline_forecast(order_series(spark, sf_dir), "txn_count"))
    return summary.withColumns({f"avg_{c}": F.round(f"avg_{c}", 4) for c in P.BOUNDS})


@register("ts12_baseline_forecast", f"WITH {BASELINE_SQL} SELECT {_ROUNDED} FROM forecast")
def ts12_baseline_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(P.baseline_forecast(order_series(spark, sf_dir), "txn_count"), *P.BOUNDS)
