"""Join, window and set shapes that several operators share."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layers import scratch_path
from .gold import VALUE


def join_many_to_one(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join that fails when a key repeats on the right: the guard is part of the one aggregation."""
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    once = F.when(F.count("*") > 1, F.raise_error(F.lit("join key repeats on the right side")))
    single = right.groupBy(*keys).agg(
        once.otherwise(F.first(F.struct(*rest))).alias("_r")
    )
    return left.join(single, keys, how).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dense_grid(series: DataFrame, key: str, low: Column, high: Column, day: str = VALUE) -> DataFrame:
    """Every day for every series: each series makes its own days, so nothing is cross-joined."""
    ids = series.select(key).filter(F.col(key).isNotNull()).distinct()
    return ids.select(key, F.explode(F.sequence(low, high)).alias(day))


def densify(rows: DataFrame, key: str, amount: str, low: Column, high: Column, day: str = VALUE, more: dict[str, Column] | None = None) -> DataFrame:
    """Daily sums of the amount, and of ``more`` aggregates, 0 on days without rows."""
    sums = {amount: F.sum(amount), **(more or {})}
    sparse = rows.groupBy(day, key).agg(*[c.alias(n) for n, c in sums.items()])
    grid = dense_grid(rows, key, low, high, day)
    return grid.join(sparse, [day, key], "left").withColumns({n: F.coalesce(n, F.lit(0.0 if n == amount else 0)) for n in sums})


def wide_table(rows: DataFrame, key: str, names: list[str], amount: str, day: str = VALUE) -> DataFrame:
    """Long to wide with given columns, zero-filled; naming the columns avoids an extra job."""
    wide = rows.groupBy(day).pivot(key, names).agg(F.sum(amount))
    return wide.fillna(0.0, names)


def string_sample(df: DataFrame, group, name: str, measure: str, n: int, separator: str = " | ") -> DataFrame:
    """Top-n names by measure per group joined in rank order.

    row_number <= n is planned with a per-partition group limit, so a hot group ships n rows per
    task and not all its names.
    """
    totals = df.groupBy(*group, name).agg(F.sum(measure).alias("_m"))
    ranked = totals.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_m"), name))
    ).filter(F.col("_r") <= n)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_r", name))), lambda p: p[name])
    return ranked.groupBy(*group).agg(F.array_join(in_order, separator).alias("sample"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left table that the right one lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def common_values(df: DataFrame, value: str, group: str) -> DataFrame:
    """Values present in every group."""
    groups = df.select(F.countDistinct(group)).scalar()
    return df.groupBy(value).agg(F.countDistinct(group).alias("_g")).filter(F.col("_g") == groups).select(value)


def first_by_order(df: DataFrame, key, value: str, order) -> DataFrame:
    return df.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def top_share_of_rows(df: DataFrame, order: str, tie: str, shares, measure: str) -> DataFrame:
    """Share of the measure held by the top share of rows; the rows are days, so one window is small."""
    ranked = df.select(
        F.row_number().over(Window.orderBy(F.desc(order), tie)).alias("_r"), F.col(measure).alias("_m")
    )
    sizes = df.agg(F.count("*").alias("n"), F.sum(measure).alias("t"))
    points = sizes.withColumn("TOP_DAY_SHARE", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    count = F.greatest(F.lit(1), F.bround(F.col("n") * F.col("TOP_DAY_SHARE"), 0).cast("bigint"))
    points = points.select("TOP_DAY_SHARE", count.alias("DAY_COUNT"), "t")
    return (
        points.join(ranked, F.col("_r") <= F.col("DAY_COUNT"))
        .groupBy("TOP_DAY_SHARE", "DAY_COUNT")
        .agg((F.sum("_m") / F.first("t")).alias("ACTUAL_AMOUNT_SHARE"))
    )


def sequence_label(prefix: str, number: Column | str, width: int = 2) -> Column:
    n = F.col(number) if isinstance(number, str) else number
    return F.format_string(f"{prefix}%0{width}d", n)


def ranged(df: DataFrame, order, name: str = "ranges") -> DataFrame:
    """The rows in sorted ranges (``_range``), written down so that counts and rows come from the same cut."""
    path = scratch_path(df.sparkSession, name)
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def prefix_sums(rows: DataFrame, order, measures: dict[str, Column]) -> DataFrame:
    """Each measure summed over all earlier rows of ``ranged`` rows, whose order is total.

    Sums are taken inside the ranges and over the totals of earlier ranges, one row per range: a parallel scan, so
    no task holds more than a range.
    """
    totals = rows.groupBy("_range").agg(*[F.sum(m).alias(f"_t_{n}") for n, m in measures.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in measures])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for n, m in measures.items()})
    out = local.join(offsets, "_range").withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in measures})
    return out.drop(*[f"_{x}_{n}" for x in "lo" for n in measures])


def numbered(df: DataFrame, order, name: str = "_number") -> DataFrame:
    """Rows with their number (from 1) in a total order."""
    rows = prefix_sums(ranged(df, order, "numbered"), order, {"_before": F.lit(1)})
    return rows.withColumn(name, F.col("_before") + 1).drop("_range", "_before")


def block_shuffle(df: DataFrame, order: str, value: str, seed: int, block: int = 28) -> DataFrame:
    """Permute blocks of consecutive rows; the permutation is a hash of seed and block number.

    Each block keeps its inner order and takes the position its hash gives it. The rows are days,
    so numbering them in one window is small.
    """
    numbered = df.select(order, value, (F.row_number().over(Window.orderBy(order)) - 1).alias("_i"))
    blocks = numbered.withColumn("_b", F.floor(F.col("_i") / block))
    key = F.xxhash64(F.lit(seed), F.col("_b"))
    shuffled = blocks.withColumn("_h", key).withColumn(
        "_to", F.row_number().over(Window.orderBy("_h", "_b", "_i")) - 1
    )
    return numbered.select(order, "_i").join(
        shuffled.select(F.col("_to").alias("_i"), F.col(value).alias(value)), "_i"
    ).drop("_i")


# --- nearest earlier rows ------------------------------------------------------------------


def history_moments(df: DataFrame, order: str, features) -> DataFrame:
    """Mean and population deviation of each feature over strictly earlier rows, by a prefix scan.

    Values are moved by their overall mean first, which keeps the sums of squares exact enough.
    """
    features = list(features)
    rows = ranged(df, [order], "history")
    centre = rows.agg(F.struct(*[F.avg(f).alias(f) for f in features]).alias("c")).scalar()
    moved = rows.withColumn("_c", centre).withColumns({f"_d_{f}": F.col(f) - F.col("_c")[f] for f in features})
    measures = {"HISTORY_ROWS": F.lit(1)}
    for f in features:
        d = F.col(f"_d_{f}")
        measures |= {f"_n_{f}": d.isNotNull().cast("long"), f"_s_{f}": d, f"_q_{f}": d * d}
    out = prefix_sums(moved, [order], measures)
    columns = {}
    for f in features:
        n, s, q = F.col(f"_n_{f}"), F.col(f"_s_{f}"), F.col(f"_q_{f}")
        columns[f"{f}_MEAN"] = F.when(n > 0, F.col("_c")[f] + s / n)
        columns[f"{f}_STD"] = F.when(n > 0, F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))))
    return out.withColumns(columns).select(*df.columns, *columns, "HISTORY_ROWS")


#: Bits per feature of the curve that puts rows with like features side by side.
CURVE_BITS = 5
#: Nearest blocks that give a row its first radius.
FIRST_BLOCKS = 12
#: Rows of a block, in tables of more or fewer rows than FEW_ROWS.
SMALL_BLOCK, LARGE_BLOCK, FEW_ROWS = 64, 512, 16_384
#: Blocks that one task call compares with a group of queries.
BUNDLE = 64


def _on_curve(rows: DataFrame, df: DataFrame, features: list[str], bits: int) -> DataFrame:
    """``_z``: position on a Z-curve through the quantile bins of the features of ``df``; nulls lie in the first bin."""
    points = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    cuts = df.agg(F.struct(*[F.percentile_approx(F.col(f).cast("double"), points, F.lit(10_000)).alias(f) for f in features]).alias("c")).scalar()
    position = F.lit(0).cast("long")
    for i, f in enumerate(features):
        bin_ = F.size(F.filter(F.col("_cuts")[f], lambda c: c < F.col(f)))  # noqa: B023
        bin_ = F.greatest(F.when(F.col(f).isNotNull(), bin_).otherwise(0), F.lit(0)).cast("long")
        for bit in range(bits):
            position = position + F.shiftleft(F.shiftright(bin_, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(features) + i)
    return rows.withColumn("_cuts", cuts).withColumn("_z", position).drop("_cuts")


def neighbour_blocks(df: DataFrame, order: str, features, block: int) -> DataFrame:
    """Rows with their history moments, ``_b`` (block of rows with like features) and ``_g`` (the rows of a block by age).

    Ages double: rows with much history do not share a radius with rows that have little.
    """
    features = list(features)
    moments = history_moments(df.select(order, *features), order, features)
    scale = {f: F.when(F.coalesce(F.col(f"{f}_STD"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"{f}_STD")) for f in features}
    bits = min(CURVE_BITS, 62 // len(features))
    rows = _on_curve(moments.withColumns({f"_s_{f}": c for f, c in scale.items()}), df, features, bits)
    rows = numbered(rows, ["_z", order], "_i")
    age = F.floor(F.log2(F.greatest(F.col("HISTORY_ROWS") / block, F.lit(1.0)))).cast("long")
    rows = rows.withColumn("_b", F.floor((F.col("_i") - 1) / block).cast("long")).withColumn("_g", F.col("_b") * 64 + age)
    path = scratch_path(df.sparkSession, "neighbour-blocks")
    rows.select(order, *features, *[f"_s_{f}" for f in features], "HISTORY_ROWS", "_b", "_g").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def block_pairs(rows: DataFrame, order: str, features, min_history: int) -> DataFrame:
    """(_g, _hb, BOUND): blocks that hold earlier rows than some query of the group, with a lower bound of the distance.

    Only the boxes meet, one row per block; nulls open a box to all sides.
    """
    low = lambda f: F.min(F.coalesce(F.col(f).cast("double"), F.lit(float("-inf")))).alias(f"_lo_{f}")
    high = lambda f: F.max(F.coalesce(F.col(f).cast("double"), F.lit(float("inf")))).alias(f"_hi_{f}")
    boxes = rows.groupBy(F.col("_b").alias("_hb")).agg(F.min(order).alias("_first"), *[low(f) for f in features], *[high(f) for f in features])
    groups = rows.filter(F.col("HISTORY_ROWS") >= min_history).groupBy("_g").agg(
        F.max(order).alias("_last"), *[low(f).alias(f"_a_{f}") for f in features], *[high(f).alias(f"_z_{f}") for f in features],
        *[F.max(f"_s_{f}").alias(f"_w_{f}") for f in features])
    bound = _box_bound(features, lambda f: F.col(f"_z_{f}"), lambda f: F.col(f"_a_{f}"), lambda f: F.col(f"_w_{f}"))
    met = groups.join(boxes, F.col("_first") < F.col("_last"))
    return met.select("_g", "_hb", "_last", bound.alias("BOUND"), *[f"_{x}_{f}" for x in ("lo", "hi") for f in features])


def _box_bound(features, high, low, scale) -> Column:
    """Lower bound of the distance from anything between ``low`` and ``high`` to a box (_lo_f, _hi_f)."""
    total = F.lit(0.0)
    for f in features:
        gap = F.greatest(F.col(f"_lo_{f}") - high(f), low(f) - F.col(f"_hi_{f}"), F.lit(0.0)) / scale(f)
        total = total + gap * gap
    return F.sqrt(total) * (1 - 1e-9)


def nearest_in_pairs(rows: DataFrame, pairs: DataFrame, order: str, features, k: int, min_history: int) -> DataFrame:
    """(order, NEIGHBOUR, DISTANCE): the k nearest earlier rows of each query in each bundle of blocks that its group meets."""
    features = list(features)
    scales = [f"_s_{f}" for f in features]
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_hb"))  # one row per block
    pairs = pairs.withColumn("_c", F.floor((place - 1) / BUNDLE))
    queries = rows.filter(F.col("HISTORY_ROWS") >= min_history).join(pairs.select("_g", "_c").distinct(), "_g")
    queries = queries.select("_g", "_c", F.lit(True).alias("_q"), order, *features, *scales)
    history = rows.withColumnsRenamed({"_b": "_hb", "_g": "_own"}).join(pairs.select("_g", "_hb", "_c", "_last"), "_hb").filter(F.col(order) < F.col("_last"))
    history = history.select("_g", "_c", F.lit(False).alias("_q"), order, *features, *scales)
    kind = dict(rows.dtypes)[order]

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[pdf["_q"]].sort_values(order)
        h = pdf[~pdf["_q"]].sort_values(order)
        out = []
        if len(q) and len(h):
            hv = h[features].to_numpy(float)
            days = h[order].to_numpy()
            for day, x, s in zip(q[order].to_numpy(), q[features].to_numpy(float), q[scales].to_numpy(float)):
                n = np.searchsorted(days, day)
                if n:
                    d = np.sqrt((((hv[:n] - x) / s) ** 2).sum(axis=1))
                    # Nearest first, the later row first among equals.
                    top = np.lexsort((-np.arange(n), d))[:k]
                    out.append(pd.DataFrame({order: day, "NEIGHBOUR": days[top], "DISTANCE": d[top]}))
        if not out:
            return pd.DataFrame({order: [], "NEIGHBOUR": [], "DISTANCE": []})
        return pd.concat(out, ignore_index=True)

    return queries.unionByName(history).groupBy("_g", "_c").applyInPandas(best, f"{order} {kind}, NEIGHBOUR {kind}, DISTANCE double")


def needed_pairs(rows: DataFrame, first: DataFrame, pairs: DataFrame, order: str, features, k: int, min_history: int) -> DataFrame:
    """The pairs whose box lies within the radius of a query: its k-th distance found so far. First by group, then by row."""
    kth = first.groupBy(order).agg(F.get(F.array_sort(F.collect_list("DISTANCE")), F.lit(k - 1)).alias("_r"))  # a few lists of k at most
    queries = rows.filter(F.col("HISTORY_ROWS") >= min_history).join(kth, order, "left").withColumn("_r", F.coalesce("_r", F.lit(float("inf"))))
    radius = queries.groupBy("_g").agg(F.max("_r").alias("_radius"))
    near = pairs.join(radius, "_g").filter(F.col("BOUND") <= F.col("_radius")).drop("_radius")
    value = lambda sign: lambda f: F.coalesce(F.col(f).cast("double"), F.lit(sign * float("inf")))
    own = _box_bound(features, value(1), value(-1), lambda f: F.col(f"_s_{f}"))
    within = near.join(queries.select("_g", "_r", *features, *[f"_s_{f}" for f in features]), "_g").filter(own <= F.col("_r"))
    return within.groupBy("_g", "_hb").agg(F.first("_last").alias("_last"))


def nearest_earlier(df: DataFrame, order: str, features, k: int, min_history: int = 1, block: int | None = None) -> DataFrame:
    """k nearest strictly earlier rows of each row by distance standardized on its own history.

    Rows with like features lie in one block. The nearest blocks first give every row a radius; then only
    blocks whose bounding box lies within the radius are met, so the result is exact and most pairs
    of blocks are never run. Queries meet a bounded bundle of blocks at a time, which gives their k best.
    """
    features = list(features)
    spark = df.sparkSession
    # Few rows in few blocks: there, calls cost more than distances.
    block = block or (SMALL_BLOCK if df.count() > FEW_ROWS else LARGE_BLOCK)
    rows = neighbour_blocks(df, order, features, block)

    def kept(name: str, part: DataFrame) -> DataFrame:
        path = scratch_path(spark, name)
        part.write.parquet(path)
        return spark.read.schema(part.schema).parquet(path)

    pairs = kept("block-pairs", block_pairs(rows, order, features, min_history))
    closest = F.row_number().over(Window.partitionBy("_g").orderBy("BOUND", "_hb"))  # one row per block
    start = kept("first-pairs", pairs.withColumn("_r", closest).filter(F.col("_r") <= FIRST_BLOCKS).drop("_r"))
    first = kept("first-neighbours", nearest_in_pairs(rows, start, order, features, k, min_history))
    rest = needed_pairs(rows, first, pairs, order, features, k, min_history).join(start.select("_g", "_hb"), ["_g", "_hb"], "left_anti")
    candidates = first.unionByName(nearest_in_pairs(rows, rest, order, features, k, min_history))
    rank = F.row_number().over(Window.partitionBy(order).orderBy("DISTANCE", F.desc("NEIGHBOUR")))
    return candidates.withColumn("RANK", rank).filter(F.col("RANK") <= k)
