"""Event profiles and quantiles from whole keys in Arrow batches, checked by plain Spark aggregates."""
import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from paytide.operators import companies as C
from paytide.operators import quantiles as Q
from paytide.operators import stats as T
from paytide.plans import q_series
from paytide.plans.tables import Tables


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _rows(spark):
    rng = random.Random(5)
    rows = [("one", dt.date(2000, 1, 31), 5.0), ("zero", dt.date(2000, 1, 1), 0.0), ("empty", dt.date(2000, 1, 1), None), ("undated", None, 3.0)]
    for key in ("a", "b", None):
        rows += [(key, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(90)), rng.choice([None, 0.0, round(rng.uniform(1, 900), 2)])) for _ in range(120)]
        rows += [(key, None, 7.0)]
    return rows, spark.createDataFrame([(k, d, x, None if x is None else -x) for k, d, x in rows], "k string, VALUE_DATE date, abs_amount double, amount double")


@pytest.mark.parametrize("positive", [True, False])
def test_event_profile_equals_plain_python(spark, small_batches, positive):
    rows, df = _rows(spark)
    profile = C.event_profile(df, ["k"], {"q": 0.9}, positive_days=positive)
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan  # no buffer of values per key
    got = {r["k"]: r for r in profile.collect()}
    near = lambda a, b: (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
    assert set(got) == {k for k, _, _ in rows}
    for key, r in got.items():
        mine = [(d, x) for k, d, x in rows if k == key]
        days = {d: [x for e, x in mine if e == d and x is not None] for d, _ in mine}
        sums = {d: sum(v) if v else None for d, v in days.items()}
        counted = [d for d in sorted(d for d in sums if d) if not positive or (sums[d] or 0) > 0]
        y = [s for s in sums.values() if s is not None and (not positive or s > 0)]
        gaps = [(b - a).days for a, b in zip(counted, counted[1:])]
        x = [v for _, v in mine if v is not None]
        assert (r["n_rows"], r["n_active_days"]) == (len(mine), sum(d is not None for d in sums))
        want = {
            "total_abs_amount": sum(x) if x else None, "total_amount": -sum(x) if x else None, "mean_abs_amount": sum(x) / len(x) if x else None,
            "max_abs_amount": max(x) if x else None, "median_daily_abs_amount": statistics.median(y) if y else None,
            "std_daily_abs_amount": statistics.stdev(y) if len(y) > 1 else None, "mean_daily_abs_amount": statistics.mean(y) if y else None,
            "median_gap_days": statistics.median(gaps) if gaps else None, "max_gap_days": max(gaps) if gaps else None,
            "cv_gap_days": statistics.stdev(gaps) / statistics.mean(gaps) if len(gaps) > 1 else None,
            "payment_abs_hhi": sum(v * v for v in x) / sum(x) ** 2 if x and sum(x) else None,
        }
        assert {c: r[c] for c in want if not near(r[c], want[c])} == {}, key
        dated = [d for d, _ in mine if d]
        assert (r["first_date"], r["last_date"]) == (min(dated, default=None), max(dated, default=None))
        for name, classes in (("dow", [d.weekday() for d in dated]), ("dom", [d.day for d in dated])):
            n = [classes.count(c) for c in set(classes)]
            entropy = -sum(c / len(classes) * math.log(c / len(classes)) for c in n) / math.log(len(n)) if len(n) > 1 else 0.0
            assert near(r[f"{name}_entropy"], entropy) and near(r[f"{name}_top_share"], max(n) / len(classes) if n else None), key


def test_quantiles_of_keys_that_cross_batches(spark, small_batches):
    _, df = _rows(spark)
    wanted = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}
    plan = Q.exact_quantiles(df, "abs_amount", wanted, ["k"])
    plain = df.filter("abs_amount IS NOT NULL").groupBy("k").agg(*[F.percentile("abs_amount", q).alias(n) for n, q in wanted.items()])
    rounded = lambda d: sorted(str([r["k"], *[round(r[n], 9) for n in wanted]]) for r in d.collect())
    assert rounded(plan) == rounded(plain)


def test_entropy_of_counts_takes_its_total_once(spark):
    df = spark.createDataFrame([([1, 0, 3],), ([0, 0, 4],), ([0, 0, 0],), ([2, 2, 2],)], "c array<bigint>")
    got = df.select(T.entropy_of_counts(F.col("c")).alias("e"))
    assert [round(r["e"], 9) for r in got.collect()] == [round((math.log(4) - 0.75 * math.log(3)) / math.log(2), 9), 0.0, 0.0, 1.0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2


def test_layers_of_rows_hold_what_is_read(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert not {"DESCRIPTION", "day_name", "ENTITY_SHORTNAME"} & set(t.prepared.columns)
    marked, _ = q_series._remaining(t)
    assert not {"DESCRIPTION", "day_name", "ENTITY_SHORTNAME"} & set(marked.columns)
    t.layers.clear()


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("absolute", [True, False])
def test_company_profile_equals_plain_python(spark, small_batches, unique, absolute):
    rng = random.Random(7)
    low, high = dt.date(2000, 1, 1), dt.date(2000, 3, 31)
    rows = [("one", low, high, 5.0, "x"), ("none", None, low, 0.0, None), ("gone", low, high, 4.0, "y"), ("gone", low, high, -4.0, "z"), ("empty", low, low, None, "e")]
    for key in ("a", "b", None):
        for i in range(90):
            day = low + dt.timedelta(days=rng.randrange(91))
            rows.append((key, rng.choice([None, day - dt.timedelta(days=rng.randrange(4))]), day, rng.choice([0.0, round(rng.uniform(-900, 900), 2)]), f"{key}{i if unique else i % 40}"))
    df = spark.createDataFrame(rows, "k string, TRADE_DATE date, VALUE_DATE date, amount double, ID string").withColumn("company_found", F.col("k").isNotNull())
    profile = C.company_profile(df, F.lit(low), F.lit(high), ["k"], absolute, unique)
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list(" not in plan and "percentile(" not in plan  # no buffer of values per key
    got = {r["k"]: r.asDict() for r in profile.collect()}
    assert set(got) == {r[0] for r in rows}
    near = lambda a, b: (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
    calendar = [low + dt.timedelta(days=i) for i in range(91)]
    for key, r in got.items():
        mine = [x for x in rows if x[0] == key]
        x = [math.fsum(v[3] or 0.0 for v in mine if v[2] == d) for d in calendar]
        days = [i for i, v in enumerate(x) if v != 0]
        size = [abs(v) for v in x]
        v = [abs(x[i]) if absolute else x[i] for i in days]
        gaps = [b - a for a, b in zip(days, days[1:])]
        leads = [(e - s).days for _, s, e, _, _ in mine if s]
        runs = lambda on: max([len(p) for p in "".join("1" if (i in days) == on else " " for i in range(91)).split()] or [0])
        half = [sum(t) for t in (x[7:], x[:-7])]
        sd = [math.sqrt(max(sum(u * u for u in t) / 84 - (s / 84) ** 2, 0)) for t, s in zip((x[7:], x[:-7]), half)]
        stem = "active_abs_daily" if absolute else "active_daily"
        total_of = size if absolute else x
        want = {
            "row_count": len({m[4] for m in mine} - {None}), "company_found": key is not None, "active_days": len(days), "calendar_days": 91, "total_amount": math.fsum(x), "total_abs_amount": sum(size),
            f"median_{stem}_amount": statistics.median(v) if v else 0.0, f"max_{stem}_amount": max(v) if v else 0.0, "longest_active_run": runs(True), "longest_zero_run": runs(False),
            "top3_day_abs_share": sum(sorted(size)[-3:]) / sum(size) if days else 0.0, "median_gap_days": statistics.median(gaps) if gaps else None,
            "cv_gap_days": statistics.stdev(gaps) / statistics.mean(gaps) if len(gaps) > 1 else None, "mean_abs_daily_diff": sum(abs(b - a) for a, b in zip(x, x[1:])) / 90,
            "weekend_active_share": sum(calendar[i].weekday() >= 5 for i in days) / len(days) if days else 0.0,
            "month_end_active_share": sum((calendar[i] + dt.timedelta(days=5)).month != calendar[i].month for i in days) / len(days) if days else 0.0,
            "rows_per_active_day_max": float(max([len({m[4] for m in mine if m[2] == calendar[i]} - {None}) for i in days] or [0])),
            "lead_days_mean": statistics.mean(leads) if leads else None, "lead_days_median": float(statistics.median(leads)) if leads else None,
            "known_same_day_share": sum(t == 0 for t in leads) / len(leads) if leads else None,
            "autocorr_lag_7": (sum(a * b for a, b in zip(x[7:], x[:-7])) / 84 - half[0] * half[1] / 84**2) / (sd[0] * sd[1]) if min(sd) > 1e-9 else None,
            "recent_30_amount_share": sum(total_of[-30:]) / sum(total_of) if days else 0.0,
        }
        assert {c: (r[c], want[c]) for c in want if not near(r[c], want[c])} == {}, key
