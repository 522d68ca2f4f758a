"""Queries of learned forecasts, ensembles and clusters."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest as K
from ..operators import baselines as M
from ..operators import clusters as C
from ..operators import companies as P
from ..operators import learners as L
from ..operators.pointintime import FeatureSpec
from .registry import query
from .tables import EVAL_FROM, EVAL_TO, SPEC, TRAIN_WINDOW

_P = ("CUTOFF_DATE", "FORECAST_DATE", "TARGET_AMOUNT", "PREDICTION")
_BASES = {"naive": M.naive_last_day, "weekly": M.seasonal_naive_weekly, "known": M.known_amount_d1}


def _fit_all(t, model, **settings):
    """Every evaluation day, fitted in one job."""
    return model(t.folds.training(), t.folds.inference(), **settings).select(*_P)


@query("model_gbt_regressor")
def _(t):
    return _fit_all(t, L.gbt_regressor)


@query("regressor_gbt_component")
def _(t):
    return L.gbt_regressor(t.folds.training().filter("TARGET_AMOUNT > 0"), t.folds.inference()).select(*_P)


@query("model_tweedie")
def _(t):
    return _fit_all(t, L.tweedie)


@query("model_zero_aware")
def _(t):
    return _fit_all(t, L.zero_aware)


@query("model_spike_cascade")
def _(t):
    return _fit_all(t, L.spike_cascade)


def _probabilities(t, classifier):
    """Probability that the amount exceeds the mean of the fold's training amounts."""
    a = t.folds.training()
    mean = a.groupBy("EVALUATION_CUTOFF").agg(F.avg("TARGET_AMOUNT").alias("_mean"))
    labelled = a.join(mean, "EVALUATION_CUTOFF").withColumn("_above", (F.col("TARGET_AMOUNT") > F.col("_mean")).cast("double"))
    return classifier(labelled, t.folds.inference(), "_above", "PREDICTION").select(*_P)


@query("classifier_logistic")
def _(t):
    return _probabilities(t, L.logistic_probability)


@query("classifier_gbt")
def _(t):
    return _probabilities(t, L.gbt_probability)


_RIDGE = ["TARGET_LAG_1", "TARGET_LAG_7", "TARGET_ROLLING_MEAN_7", "TARGET_ROLLING_MEAN_28", "KNOWN_AMOUNT_D1"]


@query("regressor_ridge")
def _(t):
    return L.ridge(t.folds.training(_RIDGE), t.folds.inference(), _RIDGE).select(*_P)


@query("cascade_labels", """SELECT EVALUATION_CUTOFF, q AS SPIKE_THRESHOLD, count(*) FILTER (y > 0) AS OCCURRENCES, count(*) FILTER (y > q) AS SPIKES, count(*) FILTER (y > 0 AND y <= q) AS NORMALS, coalesce(avg(y) FILTER (y > 0 AND y <= q), 0) AS NORMAL_FALLBACK,
       CASE WHEN coalesce(avg(y) FILTER (y > q), 0) = 0 THEN coalesce(avg(y) FILTER (y > 0 AND y <= q), 0) ELSE avg(y) FILTER (y > q) END AS SPIKE_FALLBACK
       FROM (SELECT EVALUATION_CUTOFF, round(TARGET_AMOUNT, 2) AS y, quantile_cont(CASE WHEN round(TARGET_AMOUNT, 2) > 0 THEN round(TARGET_AMOUNT, 2) END, 0.9) OVER (PARTITION BY EVALUATION_CUTOFF) AS q FROM train_rows) GROUP BY 1, 2""", "SPIKE_THRESHOLD,NORMAL_FALLBACK,SPIKE_FALLBACK:8")
def _(t):
    return L.cascade_labels(t.folds.training(()).withColumn("TARGET_AMOUNT", F.round("TARGET_AMOUNT", 2)))


@query("cascade_routing", """SELECT VALUE_DATE, po * ((1 - ps) * n + ps * b) AS soft, CASE WHEN po < 0.5 THEN 0.0 WHEN ps < 0.5 THEN n ELSE b END AS hard FROM (SELECT VALUE_DATE, (OBSERVATION_COUNT % 10) / 10 AS po, (OBSERVATION_COUNT % 7) / 7 AS ps, TARGET_AMOUNT / 2 AS n, TARGET_AMOUNT AS b FROM realized)""", "soft,hard:6")
def _(t):
    n = F.col("OBSERVATION_COUNT")
    args = (n % 10 / 10, n % 7 / 7, F.col("TARGET_AMOUNT") / 2, F.col("TARGET_AMOUNT"))
    return t.realized.select("VALUE_DATE", L.cascade_routing(*args).alias("soft"), L.cascade_routing(*args, mode="hard").alias("hard"))


@query("oof_folds", """SELECT EVALUATION_CUTOFF, TRAIN_END, TRAIN_END + 1 AS VALIDATION_START, least(TRAIN_END + 7, hi) AS VALIDATION_END FROM (SELECT *, row_number() OVER (PARTITION BY EVALUATION_CUTOFF ORDER BY TRAIN_END DESC) AS r FROM
       (SELECT EVALUATION_CUTOFF, max(CUTOFF_DATE) AS hi, CAST(unnest(generate_series(CAST(min(CUTOFF_DATE) + 29 AS TIMESTAMP), CAST(max(CUTOFF_DATE) - 1 AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS TRAIN_END FROM train_rows GROUP BY 1)) WHERE r <= 5""")
def _(t):
    return L.oof_folds(t.folds.training_cutoffs(()), max_folds=5, min_train=30, validation=7, step=7)


_OOF = dict(max_folds=5, min_train=30, validation=7, step=7)
_LAGS = ["TARGET_LAG_1", "TARGET_LAG_7", "KNOWN_AMOUNT_D1"]


@query("oof_features")
def _(t):
    training = t.folds.training(_LAGS)
    return L.oof_features(training, L.oof_folds(training, **_OOF), _BASES)


@query("model_stacking")
def _(t):
    training, features = t.folds.training(_RIDGE), ["KNOWN_AMOUNT_D1", "TARGET_ROLLING_MEAN_7"]

    def fitted(fit, rows, keys):
        return L.ridge(fit, rows, _RIDGE, keys=keys)

    bases = _BASES | {"ridge": fitted, "boosted": L.gbt_regressor, "tweedie": L.tweedie}
    return L.stacking(training, t.folds.inference(), bases, features, **_OOF).select(*_P)


_LEVELS = {"quantile/80_lower": 0.10, "quantile/80_upper": 0.90, "quantile/95_lower": 0.025, "quantile/95_upper": 0.975, "quantile/median": 0.5}


@query("model_quantile_runs")
def _(t):
    return L.quantile_runs(t.folds.training(), t.folds.inference(), _LEVELS).select("CUSTOM_NAME", *_P)


@query("quantile_shift_runs", f"""SELECT CUSTOM_NAME, CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, PREDICTION + r AS PREDICTION FROM preds JOIN
       (SELECT EVALUATION_CUTOFF, unnest({list(_LEVELS)}) AS CUSTOM_NAME, unnest(quantile_cont(TARGET_AMOUNT - TARGET_ROLLING_MEAN_7, {list(_LEVELS.values())})) AS r
       FROM train_rows GROUP BY 1) USING (EVALUATION_CUTOFF) WHERE RUN_NAME = 'moving_average'""", "TARGET_AMOUNT:2 PREDICTION:3")
def _(t):
    training = t.folds.training(["TARGET_ROLLING_MEAN_7"])
    point = M.moving_average(training, t.folds.inference())
    return L.quantile_shift_runs(training, point, F.col("TARGET_ROLLING_MEAN_7"), _LEVELS).select("CUSTOM_NAME", *_P)


@query("prediction_intervals", """SELECT p.FORECAST_DATE, p.PREDICTION, p.PREDICTION + r.l80 AS PREDICTION_LOWER_80, p.PREDICTION + r.h80 AS PREDICTION_UPPER_80, p.PREDICTION + r.l95 AS PREDICTION_LOWER_95, p.PREDICTION + r.h95 AS PREDICTION_UPPER_95 FROM preds p JOIN
       (SELECT EVALUATION_CUTOFF, quantile_cont(e, 0.1) AS l80, quantile_cont(e, 0.9) AS h80, quantile_cont(e, 0.025) AS l95, quantile_cont(e, 0.975) AS h95 FROM (SELECT EVALUATION_CUTOFF, TARGET_AMOUNT - TARGET_ROLLING_MEAN_7 AS e FROM train_rows) GROUP BY 1) r USING (EVALUATION_CUTOFF) WHERE RUN_NAME = 'moving_average'""",
       "PREDICTION,PREDICTION_LOWER_80,PREDICTION_UPPER_80,PREDICTION_LOWER_95,PREDICTION_UPPER_95:3")
def _(t):
    training = t.folds.training(["TARGET_ROLLING_MEAN_7"])
    point = M.moving_average(training, t.folds.inference())
    got = L.prediction_intervals(training, point, F.col("TARGET_ROLLING_MEAN_7"))
    return got.select("FORECAST_DATE", "PREDICTION", *[c for c in got.columns if c.startswith("PREDICTION_")])


def _median_model(train, rows):
    return [train["TARGET_AMOUNT"].median() if len(train) else 0.0] * len(rows)


@query("custom_model_hook", "SELECT CUTOFF_DATE, m AS PREDICTION FROM eval_rows JOIN (SELECT EVALUATION_CUTOFF, median(TARGET_AMOUNT) AS m FROM train_rows GROUP BY 1) ON EVALUATION_CUTOFF = CUTOFF_DATE", "PREDICTION:4")
def _(t):
    return L.custom_model(t.folds.training(()), t.folds.inference(), _median_model).select("CUTOFF_DATE", "PREDICTION")


@query("backtest_composite_frames", "SELECT 'short' AS ALIAS, EVALUATION_CUTOFF, count(*) AS n FROM train_rows GROUP BY 2 UNION ALL SELECT 'long', EVALUATION_CUTOFF, count(*) FROM train_rows GROUP BY 2")
def _(t):
    specs = {"short": FeatureSpec(lags=(1,), windows={7: ("mean",)}, history=28), "long": SPEC}
    out = None
    for alias, spec in specs.items():
        data = K.FoldData(t.realized, t.known, EVAL_FROM, EVAL_TO, TRAIN_WINDOW, spec)
        part = data.training().withColumn("ALIAS", F.lit(alias))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.groupBy("ALIAS", "EVALUATION_CUTOFF").agg(F.count("*").alias("n"))


@query("backtest_batch")
def _(t):
    training, inference = t.folds.training(_RIDGE), t.folds.inference()
    runs = {(name, "default"): model(training, inference) for name, model in M.BASELINES.items()}
    runs |= {("croston", f"smoothing_{a}"): M.croston(training, inference, a) for a in (0.1, 0.3)}
    runs[("ridge", "alpha_1")] = L.ridge(training, inference, _RIDGE)
    out = None
    for (model, custom), rows in runs.items():
        part = K.backtest_errors(rows).withColumns({"MODEL_NAME": F.lit(model), "CUSTOM_NAME": F.lit(custom)})
        out = part if out is None else out.unionByName(part)
    return out


# --- clusters ---


def _profiles(t):
    return P.company_profile(t.tx, *t.tx_span, one_row_per_id=True).persist()


def _clustered(t):
    return C.cluster_companies(_profiles(t), k=6)


@query("cluster_matrix")
def _(t):
    from pyspark.ml.functions import vector_to_array

    scaled, _ = C.cluster_matrix(_profiles(t))
    return scaled.select("company_key", F.size(vector_to_array("SCALED")).alias("slots"), F.round(vector_to_array("SCALED")[0], 6).alias("first_slot"))


@query("cluster_companies")
def _(t):
    return _clustered(t)[0].select("company_key", "auto_series_id")


@query("cluster_pca")
def _(t):
    return C.cluster_pca(_clustered(t)[0]).select("company_key", "auto_series_id", "pca_x", "pca_y")


@query("cluster_profile")
def _(t):
    clustered, names = _clustered(t)
    return C.cluster_profile(clustered, names)


@query("cluster_summary")
def _(t):
    return C.cluster_summary(_clustered(t)[0])


@query("auto_membership")
def _(t):
    return C.auto_membership(t.tx, _clustered(t)[0]).select("ID", "company_key", "series_id", "VALUE_DATE", "amount")


@query("cluster_regimes")
def _(t):
    units = P.company_profile(t.banded, *t.tx_span, keys=("company_key", "amount_band"), absolute=True, one_row_per_id=True).persist()
    return C.cluster_regimes(units).select("company_key", "amount_band", "auto_series_id", "cluster_kind")


@query("cluster_transactions")
def _(t):
    # The draws of the clustering hash the bits of the features, so amounts are added in the order of distinct IDs.
    unread = ("abs_amount", "amount_bin", "company_name", "day_name", "amount_band_display")
    rows = P.transaction_features(t.banded.drop(*unread), *t.tx_span, one_row_per_id=True, layers=t.layers)
    drop = ("company_found",)
    texts = [c for c, kind in rows.dtypes if kind in ("string", "date") and c not in ("ID", "amount_band", "company_sbc_label")]
    return C.cluster_transactions(rows.drop(*drop, *texts)).select("ID", "amount_band", "auto_series_id")


@query("auto_membership_totals", "SELECT company_key, count(*) AS n, sum(amount) AS amount, 1 AS series FROM tx GROUP BY 1", "amount:2", "n series")
def _(t):
    """Every row of a company is in the one series of its cluster."""
    members = C.auto_membership(t.tx, _clustered(t)[0])
    return members.groupBy("company_key").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.countDistinct("series_id").alias("series"))


@query("cluster_totals", "SELECT count(DISTINCT company_key) AS companies, count(*) AS n, sum(amount) AS total, least(6, count(DISTINCT company_key)) AS clusters, true AS falling FROM tx", "total:2", "companies n clusters")
def _(t):
    """The clusters share out the companies and their rows, and are numbered by falling totals."""
    summary = C.cluster_summary(_clustered(t)[0])
    above = F.lag("total_amount").over(Window.orderBy("auto_series_id"))  # one row per cluster
    return summary.withColumn("_f", F.coalesce(above >= F.col("total_amount"), F.lit(True))).agg(
        F.sum("company_count").alias("companies"), F.sum("row_count").alias("n"), F.sum("total_amount").alias("total"), F.count("*").alias("clusters"),
        F.min("_f").alias("falling"))
