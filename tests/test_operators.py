"""Small hand-written cases and properties."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from paytide.functions import labels, parsing, scoring, text
from paytide.operators import baselines, companies, learners, quantiles, series, silver, transforms
from paytide.operators import pointintime as pit
from paytide.operators.relational import join_many_to_one, nearest_earlier
from paytide.operators.rules import ColumnRule, rule_condition
from paytide.schema import movement_shape
from paytide.sources.bronze import read_bronze

D = dt.date


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_dirty_numbers_and_dates(spark):
    numbers = [("1 234,56",), ("1 234",), ("1e3",), ("NaN",), ("abc",), ("1d",), (None,)]
    assert values(spark, numbers, "x string", parsing.parse_float("x")) == [1234.56, 1234.0, 1000.0, None, None, None, None]
    assert values(spark, [("-1",), ("2,5",), ("3.5",)], "x string", parsing.parse_int("x")) == [-1, 2, 4]
    days = [("2024-02-29",), ("31/12/2024",), ("1/2/2024",), ("12/31/2024",), ("2024-13-01",), ("2024-02-30",)]
    assert values(spark, days, "x string", parsing.parse_date("x")) == [
        D(2024, 2, 29), D(2024, 12, 31), D(2024, 2, 1), D(2024, 12, 31), D(2024, 1, 13), None]
    assert values(spark, [(" a ",), (" b ",), ("NA",), ("",)], "x string", parsing.clean_text("x")) == ["a", "b", None, None]


def test_required_columns():
    shape = movement_shape()
    assert len(shape.fields) == 33 and len(shape.required) == 14
    with pytest.raises(ValueError, match="AMOUNT"):
        shape.check([c for c in shape.names if c != "AMOUNT"])


def test_null_semantics_of_rules(spark):
    df = spark.createDataFrame([("A",), ("b",), (None,)], "k string")
    keep = lambda rule: [r[0] for r in df.filter(rule_condition("k", rule)).collect()]
    assert keep(ColumnRule(include_values=("a",))) == ["A"]
    assert keep(ColumnRule(exclude_values=("a",))) == ["b", None]
    assert keep(ColumnRule(exclude_contains=(".",))) == ["A", "b", None]


def test_scores(spark):
    cases = [(100.0, 100.0), (100.0, 50.0), (100.0, 200.0), (0.0, 0.0), (0.0, 10.0)]
    assert values(spark, cases, "y double, p double", scoring.daily_score("y", "p")) == [100.0, 50.0, 50.0, 100.0, 0.0]
    got = values(spark, [(0.0, 999.0), (100.0, 100.0)], "y double, p double", scoring.weighted_score("y", "p"))
    assert got == [100.0]


def test_company_text(spark):
    raw = [("/BO/Ácme S.A./x",), ("/BO/123/x",), ("Transferencia de Foo Ltd, ref",)]
    got = values(spark, raw, "x string", text.normalize_company(text.extract_company("x")))
    assert got == ["ACME", None, "FOO"]
    assert values(spark, [(None,), (-7,), (0,), (9,)], "d int", labels.lag_bucket("d")) == [
        "missing", "5+ days before value", "same day", "5+ days after value"]


def _movements(seed, n=300):
    rng = random.Random(seed)
    base = D(2024, 1, 1)
    return [(base + dt.timedelta(v + rng.randint(-4, 6)), base + dt.timedelta(v), float(rng.randint(-500, 900)), rng.randint(1, 3))
            for v in (rng.randint(0, 80) for _ in range(n))]


KNOWN = "TRADE_DATE date, VALUE_DATE date, KNOWN_AMOUNT double, KNOWN_COUNT bigint"


def _dataset(spark, rows, start, end):
    known = spark.createDataFrame(rows, KNOWN)
    realized = known.groupBy("VALUE_DATE").agg(F.sum("KNOWN_AMOUNT").alias("TARGET_AMOUNT"), F.sum("KNOWN_COUNT").alias("OBSERVATION_COUNT"))
    spec = pit.FeatureSpec(lags=(1, 7), windows={7: ("mean", "std", "non_zero_ratio")}, history=28)
    return pit.dataset_build(realized, known, start, end, spec).orderBy("CUTOFF_DATE").collect()


def test_point_in_time_against_plain_definition(spark):
    rows = _movements(1)
    first = min(min(r[0], r[1]) for r in rows)
    for got in _dataset(spark, rows, "2024-01-02", "2024-03-10"):
        c = got["CUTOFF_DATE"]
        seen = lambda day: sum(r[2] for r in rows if r[1] == day and r[0] <= c)
        window = [seen(d) for d in (c - dt.timedelta(i) for i in range(7)) if d >= first]
        assert got["TARGET_LAG_7"] == pytest.approx(seen(c - dt.timedelta(6)))
        assert got["KNOWN_AMOUNT_D1"] == pytest.approx(seen(c + dt.timedelta(1)))
        assert got["TARGET_ROLLING_MEAN_7"] == pytest.approx(sum(window) / len(window))
        assert got["TARGET_NON_ZERO_RATIO_7"] == pytest.approx(sum(w != 0 for w in window) / len(window))


def test_later_bookings_change_no_feature(spark):
    rows = _movements(2)
    cutoff = D(2024, 2, 1)
    later = [(cutoff + dt.timedelta(k + 1), cutoff + dt.timedelta(k - 3), 1e6, 1) for k in range(6)]
    # The calendar ends stay the same, so only the new amounts could leak.
    before, after = (_dataset(spark, r, cutoff, cutoff)[0].asDict() for r in (rows, rows + later))
    before.pop("TARGET_AMOUNT"), after.pop("TARGET_AMOUNT")
    assert before == after


def test_exact_quantiles_with_a_hot_key_and_a_hot_value(spark):
    rng = random.Random(3)
    rows = [("hot", 5.0)] * 400 + [("hot", rng.random()) for _ in range(500)] + [("cold", float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, "x", {"a": 0.25, "b": 0.9}, ["k"]).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(F.percentile("x", 0.25).alias("a"), F.percentile("x", 0.9).alias("b")).collect()}
    for k in want:
        assert got[k]["a"] == pytest.approx(want[k]["a"]) and got[k]["b"] == pytest.approx(want[k]["b"])


def test_canonical_names_follow_the_sequential_rule(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ABC ") for _ in range(rng.randint(6, 14))).strip() or "A" for _ in range(70)})
    names = sorted({" ".join(n.split()) for n in names if n.split()})
    rows = [(n,) for n in names for _ in range(rng.randint(1, 6))]
    counts = {n: sum(r[0] == n for r in rows) for n in names}
    key = lambda n: " ".join(sorted(n.split()))
    leaders, want = [], {}
    for n in sorted(names, key=lambda n: (-counts[n], n)):
        hit = next((m for m in leaders if companies._indel_similarity(key(m), key(n)) >= 75), None)
        want[n] = hit or n
        if hit is None:
            leaders.append(n)
    got = companies.canonicalize_names(spark.createDataFrame(rows, "company_name string"), 75, first_heads=8)
    assert {r["name"]: r["canonical"] for r in got.collect()} == want


def test_names_with_a_common_stem_meet_similar_ones_only(spark, monkeypatch):
    names = [f"{i:09d} CUSTOMER" for i in range(0, 6000, 41)] + ["A", "AB", "ABCDEFGHIJ KLMNOPQRST UVWXYZABCD EFGH", "ABCDEFGHIJ KLMNOPQXST UVWXYZABCD EFH"]
    df = spark.createDataFrame([(n, n) for n in names], "name string, t string")
    want = {(a, b) for a in names for b in names if companies._indel_similarity(a, b) >= 90}
    assert {(r["a"], r["b"]) for r in companies.similar_pairs(df, df, 90).collect()} == want
    monkeypatch.setattr(companies, "name_similarity", lambda a, b: F.lit(100.0))  # leaves the candidates
    stems = df.filter("name LIKE '0%'")
    candidates = {(r["a"], r["b"]) for r in companies.similar_pairs(stems, stems, 90).collect()}
    assert candidates == {(a, b) for a, b in want if a.startswith("0")}


def test_first_row_per_id_moves_every_column_once(spark):
    rows = [("a", 2, None, 1.0, "x"), ("a", 1, 5, 2.0, "y"), ("a", 1, 5, 2.0, "b"), (None, 3, 1, 1.0, "n"), (None, None, 1, 1.0, "m"), ("c", 1, 1, 1.0, None)]
    df = spark.createDataFrame(rows, "ID string, TRADE_DATE int, VALUE_DATE int, AMOUNT double, T string")
    got = silver.drop_id_duplicates(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {("a", 1, 5, 2.0, "b"), (None, None, 1, 1.0, "m"), ("c", 1, 1, 1.0, None)}
    moved = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_" in line]
    assert moved and all("min_by" not in line for line in moved)


def test_nearest_earlier_across_blocks(spark):
    rng = random.Random(5)
    pts = [(i, rng.random(), rng.random()) for i in range(60)]
    df = spark.createDataFrame(pts, "t int, a double, b double")
    got = {(r["t"], r["RANK"]): r["NEIGHBOUR"] for r in nearest_earlier(df, "t", ["a", "b"], 3, 10, block=7).collect()}
    import numpy as np
    for i in range(10, 60):
        h = np.array([p[1:] for p in pts[:i]])
        d = np.sqrt((((h - np.array(pts[i][1:])) / h.std(axis=0)) ** 2).sum(axis=1))
        assert [got[(i, k + 1)] for k in range(3)] == np.argsort(d)[:3].tolist()


def test_many_to_one_guard(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="join key repeats"):
        join_many_to_one(left, right, ["k"]).collect()


def test_transform_round_trip_and_fit(spark):
    df = spark.createDataFrame([(float(x),) for x in (-30, -1, 0, 2, 500)], "x double")
    p = F.lit(0.3)
    back = [r[0] for r in df.select(transforms.inverse("yeo_johnson", transforms.yeo_johnson(F.col("x"), p), p)).collect()]
    assert back == pytest.approx([-30, -1, 0, 2, 500])
    rng = random.Random(6)
    rows = [(1, 2.718281828 ** rng.gauss(0, 1)) for _ in range(400)]
    fit = transforms.fit_power(spark.createDataFrame(rows, "f int, y double"), "box_cox", ["f"], "y").first()
    assert abs(fit["POWER"]) < 0.15 and fit["SHIFT"] == 0


def test_croston(spark):
    y = [0.0, 3.0, 0.0, 0.0, 6.0]
    size, gap, wait = 3.0, 2.0, 1.0
    for v in y:
        if v > 0:
            size, gap, wait = 0.1 * v + 0.9 * size, 0.1 * wait + 0.9 * gap, 1.0
        else:
            wait += 1
    got = values(spark, [(y,)], "y array<double>", baselines.croston_forecast(F.col("y")))
    assert got[0] == pytest.approx(size / gap)


def test_ridge_solves_every_fold(spark):
    rng = random.Random(7)
    day = D(2024, 1, 1)
    rows = [(day + dt.timedelta(f), a, b, 3 * a - 2 * b + f) for f in range(2) for a, b in ((rng.random(), rng.random()) for _ in range(50))]
    df = spark.createDataFrame(rows, "EVALUATION_CUTOFF date, a double, b double, TARGET_AMOUNT double")
    got = learners.ridge(df, df, ["a", "b"], alpha=1e-9).collect()
    assert all(abs(r["PREDICTION"] - r["TARGET_AMOUNT"]) < 1e-5 for r in got)


def test_overlapping_specs_fail(spark):
    tx = spark.createDataFrame([("1", "A", D(2024, 1, 1), 5.0)], "ID string, company_name string, VALUE_DATE date, amount double")
    specs = [series.SeriesSpec("s1", "A"), series.SeriesSpec("s2", "A", 1.0)]
    with pytest.raises(Exception, match="overlap"):
        series.manual_membership(tx, specs).collect()
    with pytest.raises(ValueError):
        series.SeriesSpec("s", "A", 2.0, 1.0)


def test_bronze_rows_are_numbered_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID;AMOUNT\n1;2\n2;\n3;4\n")
    (tmp_path / "b.csv").write_text("AMOUNT;ID;EXTRA\n7;9;z\n")
    rows = read_bronze(spark, str(tmp_path)).orderBy("_lineage_source_name", "_lineage_source_row_number").collect()
    assert [(r["_lineage_source_name"], r["_lineage_source_row_number"], r["ID"], r["AMOUNT"]) for r in rows] == [
        ("a.csv", 1, "1", "2"), ("a.csv", 2, "2", ""), ("a.csv", 3, "3", "4"), ("b.csv", 1, "9", "7")]


# --- rules with gaps, names, fold fits, stacking ---


def test_rules_with_gaps(spark):
    from paytide.operators.series import assign_by_rules

    rows = [("a", "ACME", True, "low", "misc", 5.0), ("b", None, False, "low", "misc", 5.0), ("c", "ACME", True, "high", None, 5000.0),
            ("d", "OTHER", True, None, "misc", 50.0), ("e", "ACME", True, "low", "misc", None)]
    tx = spark.createDataFrame(rows, "ID string, company_name string, company_found boolean, amount_bin string, remaining_behavior string, abs_amount double")
    fields = "priority int, enabled string, series_name string, rule_type string, company_name string, company_found string, amount_bin string, remaining_behavior string, min_abs_amount double, max_abs_amount double"

    def matched(*rules):
        got = assign_by_rules(tx, spark.createDataFrame(list(rules), fields)).collect()
        return {r["ID"]: r["series_name"] for r in got}

    for enabled in (None, "true", "True", "1", "yes", "YES"):  # missing values match anything, missing bounds are open
        assert matched((1, enabled, "s", "t", None, None, None, None, None, None)) == dict(a="s", b="s", c="s", d="s", e=None)
    assert set(matched((1, "no", "s", "t", None, None, None, None, None, None)).values()) == {None}
    got = matched((5, "1", "wide", "t", "*", "*", "*", "*", 0.0, None), (3, "1", "acme", "t", "ACME", "*", "*", "*", 0.0, 1000.0), (1, "1", "known", "t", "*", "true", "*", "misc", 10.0, 100.0),
                  (2, "1", "unknown", "t", "*", "false", "low", "*", None, 6.0))
    assert got == dict(a="acme", b="unknown", c="wide", d="known", e=None)


def test_many_rules_meet_a_row_once(spark):
    from paytide.operators.series import assign_by_rules

    tx = spark.range(50).select(F.col("id").cast("string").alias("ID"), F.lit("X").alias("company_name"), F.lit(True).alias("company_found"), F.lit("low").alias("amount_bin"), F.col("id").cast("double").alias("abs_amount"))
    rules = spark.range(12_000).select((12_000 - F.col("id")).cast("int").alias("priority"), F.lit(True).alias("enabled"), F.concat(F.lit("r"), "id").alias("series_name"), F.lit("t").alias("rule_type"),
                                       F.lit("*").alias("company_name"), F.lit("*").alias("company_found"), F.lit("*").alias("amount_bin"), F.lit("*").alias("remaining_behavior"),
                                       (F.col("id") / 300).alias("min_abs_amount"), (F.col("id") / 300 + 1).alias("max_abs_amount"))
    got = assign_by_rules(tx, rules).collect()
    assert len(got) == 50 and all(int(r["series_name"][1:]) == min(int(r["ID"]) * 300, 11_999) for r in got if float(r["ID"]) < 40)


def test_letters_that_decompose(spark):
    from paytide.functions.text import normalize_text

    got = spark.createDataFrame([("Ơ Ǎ Ế ệ ș ǖ ñ ø",)], "t string").select(normalize_text("t").alias("x")).first()["x"]
    assert got == "O A E E S U N"


def _fold_rows(spark, days=60):
    rows = [(f, d, float(d % 7) * 10 + f, float(d % 5)) for f in (1, 2) for d in range(days)]
    df = spark.createDataFrame(rows, "f int, d int, TARGET_AMOUNT double, X double")
    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c)
    return df.select(day(F.col("f") + days).alias("EVALUATION_CUTOFF"), day(F.col("d")).alias("CUTOFF_DATE"), day(F.col("d") + 1).alias("FORECAST_DATE"), "TARGET_AMOUNT", "X")


def test_folds_are_fitted_apart(spark):
    from paytide.operators.learners import gbt_regressor

    rows = _fold_rows(spark)
    mean = gbt_regressor(rows, rows, rounds=0)  # no rounds: the mean label of the fold
    got = mean.groupBy("EVALUATION_CUTOFF").agg(F.min("PREDICTION").alias("p"), F.max("PREDICTION").alias("q"), F.count("*").alias("n")).orderBy("EVALUATION_CUTOFF").collect()
    want = rows.groupBy("EVALUATION_CUTOFF").agg(F.avg("TARGET_AMOUNT").alias("m")).orderBy("EVALUATION_CUTOFF").collect()
    assert [r["n"] for r in got] == [60, 60] and all(abs(g["p"] - w["m"]) < 1e-9 and g["p"] == g["q"] for g, w in zip(got, want, strict=True))


def test_passthrough_changes_a_stacked_forecast(spark):
    from paytide.operators.learners import gbt_regressor, stacking

    rows = _fold_rows(spark)
    ask = rows.filter("CUTOFF_DATE = '2000-01-20'")
    base = {"boosted": gbt_regressor}
    plain, more = (stacking(rows, ask, base, p, min_rows=5, max_folds=2, min_train=30, validation=7, step=7).orderBy("EVALUATION_CUTOFF").collect() for p in ((), ("X",)))
    assert len(plain) == len(more) == 2 and all(abs(a["PREDICTION"] - b["PREDICTION"]) > 1e-6 for a, b in zip(plain, more, strict=True))


def test_company_names_by_guarded_patterns(spark):
    from paytide.functions import text

    words = "S A U L B V N R C SA SAU SL BV NV SARL SCA CB CO LTD LIMITED COLTD ACME X1 é".split()
    texts = [f"{a} {b}{gap}{c}" for a in words for b in words for c in words[:12] for gap in (" ", ".", "")]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    plan = df.select(text.normalize_company("d").alias("c"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1

    def plain(t):
        name = re.sub(r"[^A-Z0-9]+", " ", t.upper().replace("É", "E")).strip()
        for form in text.LEGAL_FORMS:
            name = re.sub(form, " ", name)
        return re.sub(r"\s+", " ", name).strip() or None

    got = df.select("d", text.normalize_company("d").alias("c")).collect()
    assert [r for r in got if r["c"] != plain(r["d"])] == []


def test_series_rows_hold_what_their_summaries_read(spark):
    from types import SimpleNamespace

    from paytide.plans import q_series
    from paytide.sources.layers import Layers

    rows = [(str(i), D(2024, 1, 1 + i), 10.0, 10.0, "ACME" if i else "NO_COMPANY", "under_100k", "row_0_1000", "long text") for i in range(4)]
    prepared = spark.createDataFrame(rows, "ID string, VALUE_DATE date, amount double, abs_amount double, company_clean string, amount_regime string, row_amount_bin string, DESCRIPTION string")
    own = spark.createDataFrame([("under_100k", "ACME", True, "sparse_tail", "freq_3_5", "total_lt_1k")],
                                "amount_regime string, company_clean string, is_own_series boolean, behavior_label string, freq_bin string, value_bin string")
    t = SimpleNamespace(layers=Layers(spark, "series-layers"), prepared=prepared, own_series=own)
    got = q_series._series_rows(t)
    assert "DESCRIPTION" not in got.columns
    assert {(r["ID"], r["series_id"]) for r in got.collect()} == {("0", "under_100k__NO_COMPANY__row_0_1000")} | {(str(i), "under_100k__OWN__ACME") for i in (1, 2, 3)}
    t.layers.clear()
