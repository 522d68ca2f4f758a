"""Aggregates over small domains, written so that one grouped pass is enough."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import once

WEEKDAYS, MONTH_DAYS = range(0, 7), range(1, 32)


def class_counts(value: Column, classes) -> Column:
    """Aggregate: array with the count of each class of a small fixed domain."""
    return F.array(*[F.count_if(value == c) for c in classes])


def entropy_of_counts(counts: Column) -> Column:
    """Shannon entropy over the log of the number of classes seen; 0 for one class."""
    def of_seen(seen: Column) -> Column:
        total = F.aggregate(seen, F.lit(0).cast("bigint"), lambda s, n: s + n)
        h = once(total, lambda t: F.aggregate(seen, F.lit(0.0), lambda s, n: s - n / t * F.log(n / t)))
        return F.when(F.size(seen) <= 1, 0.0).otherwise(h / F.log(F.size(seen)))

    return once(F.filter(counts, lambda n: n > 0), of_seen)


def top_share_of_counts(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, n: s + n)
    return F.when(total > 0, F.array_max(counts) / total)


def entropy_normalized(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Same measures for a value of any domain: counts per value, then per key."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    total, nlogn = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    h = F.log(total) - nlogn / total
    return counts.groupBy(*keys).agg(
        F.when(F.count("*") <= 1, 0.0).otherwise(h / F.log(F.count("*"))).alias("ENTROPY"),
        (F.max("n") / total).alias("TOP_SHARE"),
    )


def cv2(x: Column | str) -> Column:
    """Squared coefficient of variation; null for one value or a mean of zero."""
    c = F.col(x) if isinstance(x, str) else x
    ok = (F.count(c) > 1) & (F.abs(F.avg(c)) >= 1e-12)
    return F.when(ok, F.pow(F.stddev_samp(c) / F.avg(c), F.lit(2.0)))


def hhi(x: Column | str) -> Column:
    """Sum of squared shares."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.sum(c) != 0, F.sum(c * c) / F.pow(F.sum(c), F.lit(2.0)))


def gap_columns(gap: str = "GAP") -> list[Column]:
    """Aggregates of day gaps; the gaps of a key are bounded by its active days."""
    g = F.col(gap)
    return [
        F.percentile(g, 0.5).alias("median_gap_days"),
        F.avg(g).alias("mean_gap_days"),
        F.when(F.avg(g) != 0, F.stddev_samp(g) / F.avg(g)).alias("cv_gap_days"),
        F.min(g).cast("double").alias("min_gap_days"),
        F.max(g).cast("double").alias("max_gap_days"),
    ]


def with_gaps(active_days: DataFrame, keys, day: str) -> DataFrame:
    """Days since the previous active day of the key (rows are distinct key and day)."""
    by = Window.partitionBy(*keys).orderBy(day)
    return active_days.withColumn("GAP", F.datediff(F.col(day), F.lag(day).over(by)))
