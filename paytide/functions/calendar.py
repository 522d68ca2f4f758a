"""Date attributes, Monday = 0."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _col

# Calendar feature names.
CALENDAR_FEATURES = ("DAY_OF_WEEK", "DAY_OF_MONTH", "IS_MONTH_END", "IS_MONTH_START", "IS_WEEKEND")


def calendar_attributes(day: Column | str) -> list[Column]:
    d = _col(day)
    return [
        F.weekday(d).alias("DAY_OF_WEEK"),
        F.day(d).alias("DAY_OF_MONTH"),
        (d == F.last_day(d)).alias("IS_MONTH_END"),
        (F.day(d) == 1).alias("IS_MONTH_START"),
        (F.weekday(d) >= 5).alias("IS_WEEKEND"),
    ]


def month_start(day: Column | str, first_days: int = 3) -> Column:
    return F.day(_col(day)) <= first_days


def month_end(day: Column | str, from_day: int = 28) -> Column:
    d = _col(day)
    return (F.day(d) >= from_day) | (d == F.last_day(d))


def month_end_tail(day: Column | str, last_days: int = 5) -> Column:
    d = _col(day)
    return F.day(d) >= F.day(F.last_day(d)) - (last_days - 1)


def lead_days(value_date: Column | str, trade_date: Column | str) -> Column:
    return F.datediff(_col(value_date), _col(trade_date))
