"""Daily series, seasonal forecasting and what-if scenarios.

The model family is a piecewise linear trend times one plus yearly and weekly Fourier terms (or plus them, in additive
mode; Taylor & Letham 2018). Trend changes have a Laplace prior, so that most of them are zero, seasons and slope a normal
one. `solve` finds the best coefficients; one series and many use the same one.

The band comes from rolling origins: the model is fitted again on shorter histories, and its errors on the days that
followed tell how the band widens with the horizon.

A series has one row per day after aggregation, so its length is bounded by the
calendar whatever the number of transactions, and one task can fit it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.operators.joins import union_by_name
from tallywing.operators.ranking import top

# Fourier orders, changepoints over the first part of the history and
# the prior widths of slope, changepoints and seasons.
YEARLY_ORDER, WEEKLY_ORDER = 10, 3
YEAR, WEEK = 365.25, 7.0
CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
SLOPE_SCALE, CHANGEPOINT_SCALE, SEASON_SCALE = 5.0, 0.05, 10.0
# Least noise, as a share of the largest value.
NOISE = 0.001
ALTERNATIONS, SWEEPS = 12, 40
# Shorter histories that are fitted for the band, days between them, and the days that one must have.
ORIGINS, ORIGIN_STEP, SHORTEST_HISTORY = 14, 30, 60
BAND = (0.1, 0.9)
NORMAL_90 = 1.2815515655446004
SHORTEST, LONGEST = 7, 90
EPOCH = "1970-01-01"


def clamp_horizon(days: int) -> int:
    return max(SHORTEST, min(days, LONGEST))


def daily_series(
    df: DataFrame, metrics: dict[str, Column], at: str = "timestamp", by: list[str] | None = None
) -> DataFrame:
    """One row per day (and group) with the given aggregates; the day is `ds`."""
    return df.groupBy(*(by or []), F.to_date(at).alias("ds")).agg(*[m.alias(n) for n, m in metrics.items()])


def fill_calendar(series: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Every day from the first to the last of each series; a missing day counts 0."""
    keys = by or []
    span = series.groupBy(*keys).agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias("ds"))
    return days.join(series, [*keys, "ds"], "left").fillna(0, subset=metrics)


def day_number(ds: Column) -> Column:
    return F.datediff(ds, F.lit(EPOCH).cast("date"))


def fourier_features(ds: Column, yearly: int = YEARLY_ORDER, weekly: int = WEEKLY_ORDER) -> dict[str, Column]:
    out = {}
    for name, period, order in (("yearly", YEAR, yearly), ("weekly", WEEK, weekly)):
        for k in range(1, order + 1):
            angle = day_number(ds) * F.lit(2 * math.pi * k / period)
            out[f"{name}_sin_{k}"] = F.sin(angle)
            out[f"{name}_cos_{k}"] = F.cos(angle)
    return out


def changepoint_times(n: int = CHANGEPOINTS) -> list[float]:
    """Evenly over the first part of the history, which runs from 0 to 1."""
    return [CHANGEPOINT_RANGE * j / n for j in range(1, n + 1)]


def trend_features(time: Column, changepoints: int = CHANGEPOINTS) -> dict[str, Column]:
    """`time` (0 to 1 over the history) and how far it is past each changepoint."""
    hinges = {
        f"bend_{j}": F.greatest(F.lit(0.0), time - F.lit(s))
        for j, s in enumerate(changepoint_times(changepoints), 1)
    }
    return {"slope": time, **hinges}


def _trend_design(day: np.ndarray, first: float, length: float) -> np.ndarray:
    """A constant and the columns of `trend_features`."""
    time = (day - first) / max(length, 1.0)
    return np.column_stack([np.ones_like(time), time, np.maximum(0.0, time[:, None] - np.array(changepoint_times()))])


def _season_design(day: np.ndarray) -> np.ndarray:
    """The columns of `fourier_features`."""
    angles = [day * 2 * math.pi * k / p for p, n in ((YEAR, YEARLY_ORDER), (WEEK, WEEKLY_ORDER)) for k in range(1, n + 1)]
    return np.column_stack([f(a) for a in angles for f in (np.sin, np.cos)])


def coordinate_descent(
    gram: np.ndarray, target: np.ndarray, start: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, sweeps: int
) -> np.ndarray:
    """Minimise a'Ga / 2 - t'a + sum(ridge a^2) / 2 + sum(lasso |a|), one coefficient after the other."""
    a = start.copy()
    slope = gram @ a - target
    diagonal = np.diag(gram) + ridge
    for _ in range(sweeps):
        largest = 0.0
        for j in np.flatnonzero(diagonal > 0):
            pull = gram[j, j] * a[j] - slope[j]
            new = np.sign(pull) * max(abs(pull) - lasso[j], 0.0) / diagonal[j]
            if new != a[j]:
                largest = max(largest, abs(new - a[j]))
                slope += gram[:, j] * (new - a[j])
                a[j] = new
        if largest < 1e-10:
            break
    return a


def solve(day: np.ndarray, y: np.ndarray, first: float, length: float, multiplicative: bool) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season coefficients of a series scaled to at most 1.

    Trend and seasons are found in turn, each given the other: the trend by coordinate descent on its Gram matrix, the
    seasons by a ridge regression. The noise that weighs the priors is that of the residuals.
    """
    t, s = _trend_design(day, first, length), _season_design(day)
    ridge = np.zeros(t.shape[1])
    ridge[1] = 1 / SLOPE_SCALE**2
    lasso = np.full(t.shape[1], 1 / CHANGEPOINT_SCALE)
    lasso[:2] = 0.0
    trend, season = np.zeros(t.shape[1]), np.zeros(s.shape[1])
    trend[0] = y.mean()
    noise = max(float(y.std()), NOISE)
    for _ in range(ALTERNATIONS):
        wave, level = s @ season, t @ trend
        x, rest = (s * level[:, None], y - level) if multiplicative else (s, y - level)
        season = np.linalg.solve(x.T @ x + np.eye(s.shape[1]) * (noise**2 / SEASON_SCALE**2 + 1e-12), x.T @ rest)
        wave = s @ season
        x, rest = (t * (1 + wave)[:, None], y) if multiplicative else (t, y - wave)
        trend = coordinate_descent(x.T @ x, x.T @ rest, trend, noise**2 * ridge, noise**2 * lasso, SWEEPS)
        fit = _combine(t @ trend, s @ season, multiplicative)
        noise = max(float(np.sqrt(np.mean((y - fit) ** 2))), NOISE)
    return trend, season


def _combine(level, wave, multiplicative: bool):
    return level * (1 + wave) if multiplicative else level + wave


def _spread(errors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float, float, float]:
    """(a, b, c, d): the band reaches sqrt(a + b h) below and sqrt(c + d h) above at a horizon of h days.

    `errors` are pairs of horizons and errors. Quantiles of stretches of a week are fitted by a line in h that doesn't fall.
    """
    horizon, error = (np.concatenate(x) for x in zip(*errors))
    week = (horizon - 1) // 7
    at = np.unique(week)
    out = []
    for q, sign in ((BAND[0], -1.0), (BAND[1], 1.0)):
        reach = np.array([max(sign * np.quantile(error[week == w], q), 0.0) ** 2 for w in at])
        middle = at * 7 + 4.0
        slope = 0.0
        if len(at) > 1:
            slope = max(float(np.polyfit(middle, reach, 1)[0]), 0.0)
        out += [max(float(reach.mean() - slope * middle.mean()), 0.0), slope]
    return tuple(out)


def fit_series(day: np.ndarray, y: np.ndarray, multiplicative: bool) -> dict:
    """The fitted model of one series, days ascending, as the fields of MODEL."""
    scale = float(np.abs(y).max()) or 1.0
    y = y / scale

    def of(n: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        first, length = float(day[0]), float(day[n - 1] - day[0])
        return *solve(day[:n], y[:n], first, length, multiplicative), first, length

    def error(fitted: tuple, which: slice) -> np.ndarray:
        trend, season, first, length = fitted
        fit = _combine(_trend_design(day[which], first, length) @ trend, _season_design(day[which]) @ season, multiplicative)
        return (y[which] - fit) / (np.maximum(np.abs(fit), 1e-6) if multiplicative else 1.0)

    whole = of(len(day))
    ahead = min(LONGEST, len(day) // 4)
    origins = [n for i in range(ORIGINS) if (n := len(day) - ahead - i * ORIGIN_STEP) >= max(SHORTEST_HISTORY, len(day) // 2)]
    errors = [(day[n : n + ahead] - day[n - 1], error(of(n), slice(n, n + ahead))) for n in origins]
    if errors:
        band = _spread(errors)
    else:  # too short a history to forecast a part of it
        low, high = np.quantile(error(whole, slice(None)), BAND)
        band = tuple(x for q in (min(low, 0.0), max(high, 0.0)) for x in (float(q * q), float(q * q) / len(day)))
    trend, season, first, length = whole
    return {
        "first_day": first, "length": length, "scale": scale, "multiplicative": multiplicative,
        "trend": trend.tolist(), "season": season.tolist(), "band": list(band),
    }


MODEL = (
    "first_day double, length double, scale double, multiplicative boolean, trend array<double>, season array<double>, band array<double>"
)


def fit_each(series: DataFrame, by: list[str], target: str, mode: str = "multiplicative") -> DataFrame:
    """A model per series (the columns `by` and those of MODEL); a task fits one series of daily values at a time."""
    if mode not in ("multiplicative", "additive"):
        raise ValueError("mode must be 'multiplicative' or 'additive'")
    names = [f"__{i}" for i in range(len(by))]
    kinds = ", ".join(f"{n} {series.schema[k].dataType.simpleString()}" for n, k in zip(names, by))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day", kind="stable")
        model = fit_series(pdf["day"].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float), mode == "multiplicative")
        return pd.DataFrame([{n: pdf[n].iloc[0] for n in names} | model])

    rows = series.where(F.col(target).isNotNull()).select(
        *[F.col(k).alias(n) for n, k in zip(names, by)], day_number(F.col("ds")).alias("day"), F.col(target).cast("double").alias("y")
    )
    if not by:
        rows, names, kinds = rows.withColumn("__all", F.lit(1)), ["__all"], "__all int"
    fitted = rows.groupBy(*names).applyInPandas(one, f"{kinds}, {MODEL}")
    return fitted.drop("__all").withColumnsRenamed(dict(zip(names, by)))


def with_prediction(days: DataFrame) -> DataFrame:
    """Replace the columns of MODEL in `days` by `yhat` and its 80 % band, which widens with the days after the history."""
    day = day_number(F.col("ds"))
    time = (day - F.col("first_day")) / F.greatest(F.col("length"), F.lit(1.0))
    columns = {"trend": [F.lit(1.0), *trend_features(time).values()], "season": list(fourier_features(F.col("ds")).values())}

    def dot(name: str) -> Column:
        both = F.zip_with(F.array(*columns[name]), F.col(name), lambda a, b: a * b)
        return F.aggregate(both, F.lit(0.0), lambda a, b: a + b)

    level, wave = F.col("__level"), F.col("__wave")
    out = days.withColumns({"__level": dot("trend"), "__wave": dot("season")})
    out = out.withColumn("yhat", F.col("scale") * F.when(F.col("multiplicative"), level * (wave + 1)).otherwise(level + wave))
    ahead = F.greatest(day - F.col("first_day") - F.col("length"), F.lit(0.0))
    unit = F.when(F.col("multiplicative"), F.abs("yhat")).otherwise(F.col("scale"))
    reach = [unit * F.sqrt(F.col("band")[i] + F.col("band")[i + 1] * ahead) for i in (0, 2)]
    out = out.withColumns({"yhat_lower": F.col("yhat") - reach[0], "yhat_upper": F.col("yhat") + reach[1]})
    return out.drop("__level", "__wave", "first_day", "length", "scale", "multiplicative", "trend", "season", "band")


@dataclass
class Forecaster:
    """A fitted single series: one row of MODEL."""

    model: dict

    def _row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.model], MODEL)

    def save(self, spark: SparkSession, path: str) -> None:
        self._row(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forecaster:
        """A saved model; predicting from it reads no row of the table it was fitted on."""
        return Forecaster(spark.read.schema(MODEL).parquet(path).first().asDict())

    def predict(self, future: DataFrame) -> DataFrame:
        """`yhat` of each day, with its 80 % band."""
        values = {
            k: F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, list) else F.lit(v) for k, v in self.model.items()
        }
        return with_prediction(future.withColumns(values)).select(*future.columns, *BOUNDS)


def fit_forecast(series: DataFrame, target: str, mode: str = "multiplicative") -> Forecaster:
    """Fit one series."""
    found = fit_each(series, [], target, mode).first()  # one row of a fixed size
    if found is None:
        raise ValueError("the series is empty")
    return Forecaster(found.asDict())


def future_frame(series: DataFrame, horizon: int, by: list[str] | None = None) -> DataFrame:
    """The days after the last one of each series; the horizon is kept within 7 to 90."""
    last = series.groupBy(*(by or [])).agg(F.max("ds").alias("last"))
    n = clamp_horizon(horizon)
    days = F.sequence(F.date_add("last", 1), F.date_add("last", n))
    return last.select(*(by or []), F.explode(days).alias("ds"))


def forecast_each(
    series: DataFrame, by: list[str], target: str, horizon: int = 30, mode: str = "multiplicative"
) -> DataFrame:
    """Fit and forecast many series; NULL keys are one series."""
    models = fit_each(series, by, target, mode).withColumnsRenamed({k: f"__{k}" for k in by})
    future = future_frame(series, horizon, by)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    return with_prediction(future.join(models, same)).select(*by, "ds", *BOUNDS)


BOUNDS = ["yhat", "yhat_lower", "yhat_upper"]


def what_if(forecast: DataFrame, factor: float) -> DataFrame:
    """Forecast and band scaled by a factor."""
    return forecast.withColumns({c: F.col(c) * F.lit(float(factor)) for c in BOUNDS})


def forecast_metadata(
    series: DataFrame, horizon: int, count: str = "txn_count", amount: str = "total_amount", factor: float = 1.0
) -> DataFrame:
    """Horizon, size and range of the history, daily averages without decimals, and the scaled amount."""
    amount_mean = F.bround(F.avg(amount), 0)
    return series.agg(
        F.lit(clamp_horizon(horizon)).alias("forecast_days"),
        F.count("*").alias("training_days"),
        F.min("ds").cast("string").alias("range_start"),
        F.max("ds").cast("string").alias("range_end"),
        F.bround(F.avg(count), 0).alias("avg_daily_count"),
        amount_mean.alias("avg_daily_amount"),
        F.floor(amount_mean * F.lit(float(factor)) + F.lit(0.5)).alias("scenario_daily_amount"),
    )


def history_plus_forecast(series: DataFrame, target: str, forecast: DataFrame, n: int = 30) -> DataFrame:
    """The last n days of the history and the rounded forecast in one frame."""

    def whole(c: str) -> Column:
        return F.floor(F.col(c) + F.lit(0.5))

    past = top(series, n, F.desc("ds")).select(
        F.col("ds").alias("date"), F.col(target).alias("actual"), F.lit("historical").alias("type")
    )
    ahead = forecast.select(
        F.col("ds").alias("date"), whole("yhat").alias("predicted"), whole("yhat_lower").alias("lower"),
        whole("yhat_upper").alias("upper"), F.lit("forecast").alias("type"),
    )
    return union_by_name(past, ahead)


def forecast_summary(forecast: DataFrame) -> DataFrame:
    return forecast.agg(F.count("*").alias("days"), *[F.avg(c).alias(f"avg_{c}") for c in BOUNDS])


def baseline_forecast(series: DataFrame, target: str, horizon: int = 30) -> DataFrame:
    """Straight-line trend times a weekday index, with an 80 % normal band."""
    y = F.col(target).cast("double")
    x = day_number(F.col("ds")).cast("double")
    points = series.select(x.alias("x"), y.alias("y"), F.weekday("ds").alias("w"))
    line = points.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    slope, intercept = line.select("b").scalar(), line.select("a").scalar()
    trended = points.withColumn("trend", intercept + slope * F.col("x"))
    index = trended.groupBy("w").agg(F.try_divide(F.sum("y"), F.sum("trend")).alias("index"))
    error = trended.join(index, "w").agg(F.stddev_samp(F.col("y") - F.col("trend") * F.col("index"))).scalar()
    future = future_frame(series, horizon).withColumn("w", F.weekday("ds")).join(index, "w")
    fit = (intercept + slope * day_number(F.col("ds"))) * F.col("index")
    return future.withColumn("yhat", fit).select(
        "ds",
        "yhat",
        (F.col("yhat") - F.lit(NORMAL_90) * error).alias("yhat_lower"),
        (F.col("yhat") + F.lit(NORMAL_90) * error).alias("yhat_upper"),
    )


def forecast_response(
    series: DataFrame, metric: str = "count", horizon: int = 30, factor: float = 1.0
) -> DataFrame:
    """The forecast of one of the two daily targets, scaled by the what-if factor."""
    targets = {"count": "txn_count", "amount": "total_amount"}
    if metric not in targets:
        raise ValueError("metric must be 'count' or 'amount'")
    model = fit_forecast(series, targets[metric])
    return what_if(model.predict(future_frame(series, horizon)), factor)
