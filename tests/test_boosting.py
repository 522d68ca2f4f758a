"""Boosted trees and linear models of all folds against plain versions, and their plans."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from paytide.operators import boosting as B
from paytide.operators import learners as L

RNG = np.random.default_rng(11)


def plain_boost(x, y, new, head, rounds, step, depth, min_leaf):
    """Exact trees by trying every threshold of every feature at every node, one row at a time."""
    def value(r, leaf):
        if head.loss == "pinball":
            return np.quantile(r[leaf], head.q)
        return r[leaf].mean()

    start = np.quantile(y, head.q) if head.loss == "pinball" else y.mean()
    f, out = np.full(len(y), start), np.full(len(new), start)
    for _ in range(rounds):
        g = np.where(y > f, head.q, head.q - 1) if head.loss == "pinball" else y - f

        def grow(rows, asked, left):
            best = (1e-12, None)
            if left:
                for j in range(x.shape[1]):
                    values = np.unique(x[:, j])
                    for cut in (values[1:] + values[:-1]) / 2:
                        a, b = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                        if min(len(a), len(b)) >= min_leaf:
                            gain = g[a].sum() ** 2 / len(a) + g[b].sum() ** 2 / len(b) - g[rows].sum() ** 2 / len(rows)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (j, cut))
            if best[1] is None:
                v = step * value(y - f, rows)
                move[rows] = v
                asked_move[asked] = v
                return
            j, cut = best[1]
            grow(rows[x[rows, j] <= cut], asked[new[asked, j] <= cut], left - 1)
            grow(rows[x[rows, j] > cut], asked[new[asked, j] > cut], left - 1)

        move, asked_move = np.zeros(len(y)), np.zeros(len(new))
        grow(np.arange(len(y)), np.arange(len(new)), depth)
        f, out = f + move, out + asked_move
    return out


@pytest.mark.parametrize("head", [B.Head(), B.Head(loss="pinball", q=0.8)])
def test_histogram_trees_equal_exact_trees(head):
    x = np.round(RNG.normal(size=(70, 3)), 1)
    y = np.round(3 * x[:, 0] * (x[:, 1] > 0) + RNG.normal(size=70), 3)
    new = np.round(RNG.normal(size=(40, 3)), 2)
    got = B.boost(x, y, new, head, rounds=12, step=0.3, depth=3, min_leaf=5, bins=255)
    assert np.allclose(got, plain_boost(x, y, new, head, 12, 0.3, 3, 5), atol=1e-9)


def test_quantile_runs_cover_their_training_rows():
    x = RNG.normal(size=(365, 6))
    y = np.exp(x[:, 0] + RNG.normal(size=365))
    inside = {}
    for q in (0.025, 0.1, 0.5, 0.9, 0.975):
        inside[q] = (y <= B.boost(x, y, x, B.Head(loss="pinball", q=q), **B.BUDGET)).mean()
    assert all(abs(inside[q] - q) < 0.05 for q in inside), inside
    assert abs(inside[0.9] - inside[0.1] - 0.8) < 0.07 and inside[0.975] - inside[0.025] > 0.88


def test_linear_models_rest_where_the_gradient_vanishes():
    x = RNG.normal(size=(200, 4)) * [1, 50, 0.1, 3] + [0, 9, 1, 2]
    p = 1 / (1 + np.exp(-(x[:, 0] - x[:, 3] / 3)))
    flag = (RNG.random(200) < p).astype(float)
    a = np.c_[np.ones(200), (x - x.mean(axis=0)) / x.std(axis=0)]
    fitted = B.linear(x, flag, x, B.Head(loss="linear_logistic", reg=0.01))
    weight = np.where(flag == 1, 0.5 / flag.mean(), 0.5 / (1 - flag.mean()))
    b = np.linalg.lstsq(a, np.log(fitted / (1 - fitted)), rcond=None)[0]
    gradient = a.T @ (weight * (fitted - flag)) / 200 + 0.01 * np.r_[0, b[1:]]
    assert np.abs(gradient).max() < 1e-7
    y = np.where(RNG.random(200) < 0.4, 0, np.exp(x[:, 0]))
    mu = B.linear(x, y, x, B.Head(loss="linear_tweedie", reg=0.1)) / y.mean()
    b = np.linalg.lstsq(a, np.log(mu), rcond=None)[0]
    gradient = a.T @ (mu**0.5 - y / y.mean() * mu**-0.5) / 200 + 0.1 * np.r_[0, b[1:]]
    assert np.abs(gradient).max() < 1e-7


def _folds(spark, folds, days=60):
    rows = spark.range(folds * days).select((F.col("id") / days).cast("int").alias("f"), (F.col("id") % days).cast("int").alias("d"))
    rows = rows.withColumns({"X": (F.col("d") * 37 % 11).cast("double"), "Y": F.when(F.col("d") % 5 == 0, None).otherwise(F.col("d") % 3).cast("double")})
    rows = rows.withColumn("TARGET_AMOUNT", F.when(F.col("X") > 4, 100.0 + F.col("f")).otherwise(0.0) + F.when(F.col("d") % 13 == 0, 900.0).otherwise(0.0))
    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c)
    return rows.select(day(F.col("f") + days).alias("EVALUATION_CUTOFF"), day(F.col("d")).alias("CUTOFF_DATE"), day(F.col("d") + 1).alias("FORECAST_DATE"), "TARGET_AMOUNT", "X", "Y")


def test_one_job_for_any_number_of_folds(spark):
    jobs = {}
    for n in (2, 12):
        rows = _folds(spark, n)
        group = f"folds-{n}"
        spark.sparkContext.setJobGroup(group, group)
        got = L.gbt_regressor(rows, rows)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)  # nothing runs while the plan is built
        got.write.format("noop").mode("overwrite").save()
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] == jobs[12]


def test_models_of_odd_folds(spark):
    rows = _folds(spark, 3)
    ask = rows.filter("CUTOFF_DATE >= '2000-02-20'")
    training = rows.filter("EVALUATION_CUTOFF > '2000-03-01' OR CUTOFF_DATE < '2000-01-02'")  # the first fold has one row
    training = training.filter("EVALUATION_CUTOFF < '2000-03-03'")  # the last has none
    for model in (L.gbt_regressor, L.tweedie, L.zero_aware, L.spike_cascade):
        got = model(training, ask).collect()
        assert len(got) == ask.count() and all(np.isfinite(r["PREDICTION"]) for r in got)
        assert {r["PREDICTION"] for r in got if str(r["EVALUATION_CUTOFF"]) == "2000-03-03"} == {0.0}
        assert model(training.limit(0), ask.limit(0)).count() == 0
    runs = L.quantile_runs(training, ask, {"low": 0.1, "high": 0.9}, rounds=20)
    wide = runs.groupBy("EVALUATION_CUTOFF", "CUTOFF_DATE").pivot("CUSTOM_NAME").agg(F.first("PREDICTION"))
    assert wide.filter("low > high").isEmpty() and wide.count() == ask.count()
    for classifier in ("gbt", "logistic"):
        p = L.zero_aware(training, ask, classifier).agg(F.min("PREDICTION"), F.max("PREDICTION")).first()
        assert p[0] >= -1e-6 and p[1] < 2000


@pytest.mark.parametrize("kind", ["none", "log1p", "box_cox", "yeo_johnson"])
def test_a_transformed_forecast_comes_back_in_amounts(spark, sf_dir, kind):
    """A model that returns yesterday's amount gives it back in the original units, whatever the units of the fold."""
    from paytide.operators import transforms as X
    from paytide.operators.backtest import FoldData
    from paytide.operators.pointintime import FeatureSpec
    from paytide.plans.tables import Tables

    t = Tables(spark, sf_dir)
    size = lambda df, c: df.withColumn(c, F.abs(c))
    spec = FeatureSpec(lags=(1,), windows={}, history=28, cross=False)
    folds = FoldData(size(t.realized, "TARGET_AMOUNT"), size(t.known, "KNOWN_AMOUNT"), "2000-01-01", "2000-01-05", 30, spec)
    last = lambda training, rows: rows.withColumn("PREDICTION", F.col("TARGET_LAG_1"))
    got = {r["CUTOFF_DATE"]: r for r in X.transformed_backtest(folds, kind, last).collect()}
    want = {r["CUTOFF_DATE"]: r for r in folds.inference().collect()}
    assert got.keys() == want.keys() and len(got) == 5
    for day, r in got.items():
        assert r["PREDICTION"] == pytest.approx(want[day]["TARGET_LAG_1"], rel=1e-6, abs=1e-3)
        assert r["TARGET_AMOUNT"] == pytest.approx(want[day]["TARGET_AMOUNT"])
