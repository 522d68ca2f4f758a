"""Exact ranks, running sums and quantiles that never put a whole key into one task.

Equal values are first counted (map-side combine), so a value held by many rows is one row. The
distinct values are then cut into ranges by an approximate sketch; running sums are taken inside
the ranges and the few range totals are added as offsets. The result is exact for any sketch:
the sketch only decides how evenly the ranges are filled.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .keyed import Keyed, per_key

RANGES = 64


def cumulative_by_value(df: DataFrame, value: str, measures: dict[str, Column], keys=(), ranges: int = RANGES) -> DataFrame:
    """One row per (keys, value) with each measure, its sum below (X_BEFORE), up to it (X_THROUGH) and in all (X_ALL)."""
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()])
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(value, points, F.lit(10 * ranges)).alias("_cuts"))
    if keys:
        renamed = cuts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_cuts")
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        ranged = counted.join(renamed, on).drop(*[f"_k_{k}" for k in keys])
    else:
        ranged = counted.withColumn("_cuts", cuts.scalar())
    ranged = ranged.withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in measures])
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_k_range"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in measures],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*keys)).alias(f"{n}_ALL") for n in measures],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_range") == F.col("_k_range")]
    joined = ranged.join(offsets, on)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for n in measures:
        through = F.sum(n).over(inside) + F.col(f"_o_{n}")
        out += [F.col(n), (through - F.col(n)).alias(f"{n}_BEFORE"), through.alias(f"{n}_THROUGH"), F.col(f"{n}_ALL")]
    return joined.select(*keys, value, *out)


def totals_by_key(df: DataFrame, columns: dict[str, Column], keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def attach(df: DataFrame, small: DataFrame, keys=()) -> DataFrame:
    """Join per-key values back; without keys the one row comes as scalar subqueries."""
    keys = list(keys)
    if not keys:
        return df.withColumns({c: small.select(c).scalar() for c in small.columns})
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in small.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])


#: Distinct values of a key that one aggregation buffer may hold.
BUFFERED = 100_000


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], keys=(), buffered: int = BUFFERED) -> DataFrame:
    """Linearly interpolated quantiles per key: {column name: probability}.

    Equal values are counted first. A key of at most ``buffered`` distinct values is one aggregate over its
    counts; larger keys go through the ranges. There are few of these: each has more than ``buffered`` counted rows.
    """
    keys = list(keys)
    if not keys:
        return _ranged_quantiles(df, value, F.count(F.lit(1)), quantiles, keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    large = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > buffered)
    marked = attach(counted, F.broadcast(large), keys)
    held = marked.filter("_d IS NULL").select(*keys, F.col(value).cast("double").alias("_v"), "_n")
    schema = StructType([*held.select(*keys).schema.fields, *[StructField(name, DoubleType()) for name in quantiles]])

    def at(k: Keyed) -> dict:
        (x, used), (n, _) = k.values("_v"), k.values("_n")
        found = k.quantiles(x, used, n, quantiles.values())
        return {name: (v, np.ones(k.n, dtype=bool)) for name, v in zip(quantiles, found)}

    small = per_key(held, keys, ["_v"], schema, at)
    return small.unionByName(_ranged_quantiles(marked.filter("_d IS NOT NULL"), value, F.sum("_n"), quantiles, keys))


def _ranged_quantiles(df: DataFrame, value: str, rows: Column, quantiles: dict[str, float], keys: list[str]) -> DataFrame:
    ranked = cumulative_by_value(df, value, {"_rows": rows}, keys).withColumnRenamed("_rows_ALL", "_total")
    out = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        holds = lambda r: (F.col("_rows_BEFORE") <= r) & (r < F.col("_rows_THROUGH"))
        at_low = F.max(F.when(holds(low), F.col(value)))
        at_high = F.max(F.when(holds(high), F.col(value)))
        fraction = F.max(position - low)
        out.append((at_low + fraction * (at_high - at_low)).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def percent_ranks(df: DataFrame, names: dict[str, str], keys=()) -> DataFrame:
    """Average-tie percent ranks (largest = 1) as new columns: {column: rank column}.

    The values of all columns are ranked in one pass over a long table keyed by the column's name.
    """
    keys = list(keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in names])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p._c", "_p._v")
    ranked = cumulative_by_value(long, "_v", {"_rows": F.count(F.lit(1))}, [*keys, "_c"])
    rank = (F.col("_rows_BEFORE") + (F.col("_rows") + 1) / 2) / F.col("_rows_ALL")
    ranked = ranked.select(*keys, "_c", "_v", rank.alias("_r"))
    out = df
    for value, name in names.items():
        own = ranked.filter(F.col("_c") == value).select(*keys, F.col("_v").alias("_value"), F.col("_r").alias(name))
        out = attach(out.withColumn("_value", F.col(value).cast("double")), own, [*keys, "_value"]).drop("_value")
    return out


def weighted_quantiles(df: DataFrame, value: str, weight: Column, probabilities, keys=()) -> DataFrame:
    """Quantiles interpolated on the cumulative weight share: rows (keys, PROBABILITY, VALUE)."""
    keys = list(keys)
    shares = cumulative_by_value(df.filter(weight >= 0), value, {"_w8": F.sum(weight)}, keys)
    total = shares.groupBy(*keys).agg(F.max("_w8_THROUGH").alias("_w")).filter("_w > 0")
    points = total.withColumn("PROBABILITY", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    shares = attach(shares, total, keys).filter("_w > 0")
    shares = shares.withColumns({"_to": F.col("_w8_THROUGH") / F.col("_w")})
    # The bracket of each probability: last point at or below it, first point above it.
    tagged = shares.withColumn("PROBABILITY", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    below = F.col("_to") <= F.col("PROBABILITY")
    point = F.struct("_to", F.col(value).alias("v"))
    bracket = tagged.groupBy(*keys, "PROBABILITY").agg(
        F.max(F.when(below, point)).alias("lo"), F.min(F.when(~below, point)).alias("hi")
    )
    step = (F.col("PROBABILITY") - F.col("lo._to")) / (F.col("hi._to") - F.col("lo._to"))
    result = (
        F.when(F.col("lo").isNull(), F.col("hi.v"))
        .when(F.col("hi").isNull(), F.col("lo.v"))
        .otherwise(F.col("lo.v") + step * (F.col("hi.v") - F.col("lo.v")))
    )
    return bracket.select(*keys, "PROBABILITY", result.alias("VALUE"))
