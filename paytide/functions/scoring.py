"""Business score: the smaller of forecast and actual as a percentage of the larger."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _col


def clipped(c: Column | str) -> Column:
    return F.greatest(F.coalesce(_col(c), F.lit(0.0)), F.lit(0.0))


def daily_score(actual: Column | str, forecast: Column | str) -> Column:
    y, p = clipped(actual), clipped(forecast)
    return (
        F.when(y > 0, 100.0 * F.least(y, p) / F.greatest(y, p))
        .when(p > 0, F.lit(0.0))
        .otherwise(F.lit(100.0))
    )


def weighted_score(actual: Column | str, forecast: Column | str) -> Column:
    """Aggregate: amount-weighted mean of the daily score, null without any amount."""
    y = clipped(actual)
    total = F.sum(y)
    return F.when(total > 0, F.sum(daily_score(actual, forecast) * y) / total)
