"""Forecasts that are expressions or grouped aggregates: every fold in one job."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import EVAL, PREDICTION, training_stats
from .gold import TARGET
from .pointintime import CUTOFF, FORECAST


def _predict(inference: DataFrame, feature: str, training: DataFrame, fallback: str, keys, last_n=None) -> DataFrame:
    stats = training_stats(training, keys, last_n).select(*keys, fallback)
    joined = inference.join(stats, list(keys), "left")
    own = F.col(feature) if feature in inference.columns else F.lit(None).cast("double")
    return joined.withColumn(PREDICTION, F.coalesce(own, F.col(fallback), F.lit(0.0))).drop(fallback)


def naive_last_day(training, inference, keys=(EVAL,)) -> DataFrame:
    return _predict(inference, "TARGET_LAG_1", training, "LAST_VALUE", keys)


def seasonal_naive_weekly(training, inference, keys=(EVAL,)) -> DataFrame:
    return _predict(inference, "TARGET_LAG_7", training, "LAST_VALUE", keys)


def moving_average(training, inference, window_days: int = 7, keys=(EVAL,)) -> DataFrame:
    if window_days < 1:
        raise ValueError("window_days must be positive")
    feature = f"TARGET_ROLLING_MEAN_{window_days}"
    return _predict(inference, feature, training, f"MEAN_LAST_{window_days}", keys, window_days)


def known_amount_d1(training, inference, keys=(EVAL,)) -> DataFrame:
    return _predict(inference, "KNOWN_AMOUNT_D1", training, "MEAN_VALUE", keys)


# Registry: name -> function(training, inference) -> inference rows with PREDICTION.
BASELINES = {
    "naive_last_day": naive_last_day,
    "seasonal_naive_weekly": seasonal_naive_weekly,
    "moving_average": moving_average,
    "known_amount_d1": known_amount_d1,
}


def daily_series_fill(rows: DataFrame, keys=(EVAL,)) -> DataFrame:
    """Last value per day on a gap-free daily grid per key, gaps as 0."""
    per_day = rows.groupBy(*keys, FORECAST).agg(F.max_by(TARGET, CUTOFF).alias("Y"))
    span = per_day.groupBy(*keys).agg(F.min(FORECAST).alias("_lo"), F.max(FORECAST).alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(FORECAST))
    return grid.join(per_day, [*keys, FORECAST], "left").withColumn("Y", F.coalesce("Y", F.lit(0.0)))


def training_arrays(rows: DataFrame, keys=(EVAL,)) -> DataFrame:
    """Ordered label array per fold; its length is the training window."""
    filled = daily_series_fill(rows, keys)
    pairs = F.array_sort(F.collect_list(F.struct(FORECAST, "Y")))
    return filled.groupBy(*keys).agg(F.transform(pairs, lambda p: p["Y"]).alias("Y"))


def croston_forecast(y: Column, smoothing: float = 0.1) -> Column:
    """Croston (1972): smoothed demand size over smoothed interval, as one fold over the array."""
    a = F.lit(float(smoothing))
    first = F.array_position(F.transform(y, lambda v: v > 0), True)
    first = F.greatest(first.cast("double"), F.lit(1.0))
    start = F.struct(
        F.element_at(y, first.cast("int")).alias("size"), first.alias("gap"), F.lit(1.0).alias("wait")
    )

    def step(s, v):
        hit = v > 0
        return F.struct(
            F.when(hit, a * v + (1 - a) * s["size"]).otherwise(s["size"]).alias("size"),
            F.when(hit, a * s["wait"] + (1 - a) * s["gap"]).otherwise(s["gap"]).alias("gap"),
            F.when(hit, F.lit(1.0)).otherwise(s["wait"] + 1).alias("wait"),
        )

    return F.aggregate(y, start, step, lambda s: s["size"] / s["gap"])


# Grid over which the smoothing weight is chosen by squared one-step error.
ALPHA_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


def smoothing_fit(y: Column, alpha: Column) -> Column:
    """Struct(sse, level) of simple exponential smoothing started at the first value."""
    start = F.struct(F.lit(0.0).alias("sse"), F.element_at(y, 1).alias("level"))

    def step(s, v):
        e = v - s["level"]
        return F.struct((s["sse"] + e * e).alias("sse"), (s["level"] + alpha * e).alias("level"))

    return F.aggregate(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), start, step)


def best_smoothing(y: Column, grid=ALPHA_GRID) -> Column:
    """Level of the smoothing weight with the least squared error."""
    fits = F.transform(F.array(*[F.lit(a) for a in grid]), lambda a: smoothing_fit(y, a))
    return F.array_min(fits)["level"]


def croston(training, inference, smoothing: float = 0.1, keys=(EVAL,)) -> DataFrame:
    arrays = training_arrays(training, keys).select(*keys, croston_forecast(F.col("Y"), smoothing).alias(PREDICTION))
    return inference.join(arrays, list(keys))


def theta(training, inference, period: int = 7, keys=(EVAL,)) -> DataFrame:
    """Smoothing plus half the linear trend on the weekday-adjusted series, weekday effect added back."""
    filled = daily_series_fill(training, keys)
    keys = list(keys)
    slot = lambda day: F.pmod(F.unix_date(day), F.lit(period))
    base = filled.groupBy(*keys).agg(F.avg("Y").alias("_mean"))
    seasonal = (
        filled.groupBy(*keys, slot(F.col(FORECAST)).alias("_slot"))
        .agg(F.avg("Y").alias("_level"))
        .join(base, keys)
        .select(*keys, "_slot", (F.col("_level") - F.col("_mean")).alias("_season"))
    )
    adjusted = (
        filled.withColumn("_slot", slot(F.col(FORECAST)))
        .join(seasonal, [*keys, "_slot"])
        .select(*keys, FORECAST, (F.col("Y") - F.col("_season")).alias("Y"))
    )
    fitted = adjusted.groupBy(*keys).agg(
        F.regr_slope("Y", F.unix_date(FORECAST).cast("double")).alias("_slope"),
        F.transform(F.array_sort(F.collect_list(F.struct(FORECAST, "Y"))), lambda p: p["Y"]).alias("_y"),
    )
    level = fitted.select(
        *keys, (best_smoothing(F.col("_y")) + F.coalesce(F.col("_slope"), F.lit(0.0)) / 2).alias("_level")
    )
    return (
        inference.join(level, keys)
        .withColumn("_slot", slot(F.col(FORECAST)))
        .join(seasonal, [*keys, "_slot"], "left")
        .withColumn(PREDICTION, F.col("_level") + F.coalesce("_season", F.lit(0.0)))
        .drop("_level", "_slot", "_season")
    )


def imapa(training, inference, max_level: int = 7, keys=(EVAL,)) -> DataFrame:
    """Mean of smoothed forecasts over temporal aggregation levels, each per day."""
    arrays = training_arrays(training, keys)
    levels = arrays.select(*keys, "Y", F.explode(F.sequence(F.lit(1), F.lit(max_level))).alias("_m"))
    usable = F.floor(F.size("Y") / F.col("_m"))
    start = F.size("Y") - usable * F.col("_m")
    buckets = F.transform(
        F.sequence(F.lit(0), usable.cast("int") - 1),
        lambda b: F.aggregate(
            F.slice(F.col("Y"), (start + b * F.col("_m") + 1).cast("int"), F.col("_m")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        ),
    )
    per_level = levels.filter(usable >= 1).select(*keys, "_m", buckets.alias("_b"))
    forecasts = per_level.select(*keys, (best_smoothing(F.col("_b")) / F.col("_m")).alias("_f"))
    return inference.join(forecasts.groupBy(*keys).agg(F.avg("_f").alias(PREDICTION)), list(keys))


def ar_lag(training, inference, keys=(EVAL,)) -> DataFrame:
    """AR(1) without constant by conditional least squares: sum(y*prev)/sum(prev*prev) per fold."""
    filled = daily_series_fill(training, keys)
    previous = filled.select(*keys, F.date_add(FORECAST, 1).alias(FORECAST), F.col("Y").alias("_p"))
    pairs = filled.join(previous, [*keys, FORECAST])
    cross, square = F.sum(F.col("Y") * F.col("_p")), F.sum(F.col("_p") * F.col("_p"))
    phi = pairs.groupBy(*keys).agg(F.when(square > 0, cross / square).otherwise(0.0).alias("_phi"))
    last = training_stats(training, keys).select(*keys, "LAST_VALUE")
    return (
        inference.join(phi, list(keys))
        .join(last, list(keys))
        .withColumn(PREDICTION, F.col("_phi") * F.col("LAST_VALUE"))
        .drop("_phi", "LAST_VALUE")
    )
