"""Written layers, and plans that stay small because of them."""
import re

from pyspark.sql import functions as F

from paytide.operators import quantiles as Q
from paytide.plans import q_series
from paytide.plans.tables import Tables
from paytide.sources.layers import Layers


def _joins(df) -> int:
    return len(re.findall(r"Join ", df._jdf.queryExecution().optimizedPlan().toString()))


def test_a_layer_is_built_once_and_can_be_removed(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("x", F.rand())

    layers = Layers(spark)
    first = layers.get("a", build)
    assert layers.get("a", build).exceptAll(first).count() == 0 and len(calls) == 1
    path = layers.path
    layers.clear()
    assert layers.path is None and layers.get("a", build).count() == 5 and len(calls) == 2 and layers.path != path
    layers.clear()


def test_assignment_plans_stay_small(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assigned = q_series._assigned(t)
    assert _joins(assigned) < 30
    summary = q_series.R.assigned_summary(assigned)
    assert _joins(summary) < 30 and len(summary._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert summary.agg(F.sum("rows")).first()[0] == t.tx.count()
    t.layers.clear()


def test_large_keys_take_the_ranges(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 != 0, F.col("id") * 37 % 1009 / 7).alias("x"))
    rows = rows.withColumn("k", F.when(F.col("k") > 0, F.col("k")))  # a null key
    wanted = {"a": 0.0, "b": 0.37, "c": 1.0}
    plain = sorted(map(str, rows.groupBy("k").agg(*[F.round(F.percentile("x", q), 9).alias(n) for n, q in wanted.items()]).collect()))
    for buffered in (10, 100_000):
        got = Q.exact_quantiles(rows, "x", wanted, ["k"], buffered)
        assert sorted(map(str, got.select("k", *[F.round(n, 9).alias(n) for n in wanted]).collect())) == plain


def test_ranks_of_several_columns_in_one_pass(spark):
    rows = spark.createDataFrame([("a", 1.0, 5), ("a", 1.0, 4), ("a", 3.0, None), (None, 2.0, 1)], "k string, x double, n int")
    got = {(r["k"], r["x"], r["n"]): (r["rx"], r["rn"]) for r in Q.percent_ranks(rows, {"x": "rx", "n": "rn"}, ["k"]).collect()}
    assert got == {("a", 1.0, 5): (0.5, 1.0), ("a", 1.0, 4): (0.5, 0.5), ("a", 3.0, None): (1.0, None), (None, 2.0, 1): (1.0, 1.0)}


def test_most_blocks_are_out_of_reach(spark):
    """Ten times the calendar: fewer than a third of the pairs of rows are compared (exactness has a test of its own)."""
    import numpy as np
    import pandas as pd

    from paytide.operators import relational as R

    rng = np.random.default_rng(3)
    n, k = 25_000, 5
    level = np.cumsum(rng.normal(size=n)) / 40
    x = np.stack([np.arange(n) % 7, level + rng.normal(size=n), np.roll(level, 7) + rng.normal(size=n), level, np.round(level, 1)], axis=1)
    names = ["w", "a", "b", "c", "d"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(t=np.arange(n)))
    rows = R.neighbour_blocks(df, "t", names, 64)
    pairs = R.block_pairs(rows, "t", names, 180)
    closest = pairs.selectExpr("*", "row_number() OVER (PARTITION BY _g ORDER BY BOUND, _hb) AS r").filter(f"r <= {R.FIRST_BLOCKS}").drop("r")
    first = R.nearest_in_pairs(rows, closest, "t", names, k, 180)
    met = R.needed_pairs(rows, first, pairs, "t", names, k, 180).select("_g", "_hb").union(closest.select("_g", "_hb")).distinct()
    sizes, groups = rows.groupBy("_b").count().toDF("_hb", "h"), rows.groupBy("_g").count().toDF("_g", "q")
    met.persist()
    work = lambda p: p.join(sizes, "_hb").join(groups, "_g").selectExpr("sum(h * q) AS w").first()["w"]
    assert work(met) < work(pairs) / 3


def test_shuffle_files_go_with_a_written_layer(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen = []

    def build():
        seen.append(spark.conf.get(key))
        return spark.range(9).groupBy((F.col("id") % 3).alias("k")).count()

    layers = Layers(spark)
    assert layers.get("a", build).count() == 3 and seen == ["true"] and spark.conf.get(key) == "false"
    layers.drop("a")
    assert layers.get("a", build).count() == 3 and len(seen) == 2
    layers.clear()


def test_an_extract_keeps_no_layer_that_only_it_reads(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert t.tx.count() and t.regime_profile.count()
    assert set(t.layers._schemas) == {"tx", "prepared", "regime_profile"} and "DESCRIPTION" not in t.tx.columns
    t.layers.clear()


def test_series_outputs_are_whole(spark, tmp_path):
    """Long rows hold the amount, its size and the rows of a day, wide ones a column per series, and the rows are kept."""
    from paytide.operators import series as R
    from paytide.sources import layers as L

    rows = spark.createDataFrame([("S1", "2000-01-01", 5.0), ("S1", "2000-01-01", -7.0), ("S2", "2000-01-03", 4.0)], "series_id string, d string, amount double")
    rows = rows.select("series_id", F.col("d").cast("date").alias("VALUE_DATE"), "amount", F.abs("amount").alias("abs_amount"))
    low, high = F.lit("2000-01-01").cast("date"), F.lit("2000-01-03").cast("date")
    wide = R.daily_series_wide(rows, "series_id", R.series_names(rows), low, high)
    L.write_series_outputs(str(tmp_path), R.daily_series_long(rows, low, high), wide, rows, extra=rows.groupBy("series_id").count())
    long = spark.read.parquet(f"{tmp_path}/series_daily_long").orderBy("series_id", "VALUE_DATE")
    assert [tuple(r) for r in long.select("series_id", "amount", "abs_amount", "n_rows").collect()] == [
        ("S1", -2.0, 12.0, 2), ("S1", 0.0, 0.0, 0), ("S1", 0.0, 0.0, 0), ("S2", 0.0, 0.0, 0), ("S2", 0.0, 0.0, 0), ("S2", 4.0, 4.0, 1)]
    read = spark.read.option("header", True)
    assert read.csv(f"{tmp_path}/series_daily_wide").orderBy("VALUE_DATE").select("S1", "S2").collect()[0][:] == ("-2.0", "0.0")
    assert spark.read.parquet(f"{tmp_path}/assigned_transactions").count() == 3 and read.csv(f"{tmp_path}/extra").count() == 2
