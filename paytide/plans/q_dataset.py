"""Queries of point-in-time datasets, transforms, forecasts and backtests."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as K
from ..operators import baselines as M
from ..operators import gold as G
from ..operators import pointintime as D
from ..operators import transforms as X
from .registry import query
from .tables import EVAL_FROM, EVAL_TO, GRAIN, RULESET, SPEC, TRAIN_WINDOW

_EVAL = "CUTOFF_DATE BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'"
_LAGS = "TARGET_LAG_1, TARGET_LAG_7, TARGET_LAG_14, TARGET_LAG_28"
_LAG_DIGITS = "TARGET_LAG_1,TARGET_LAG_7,TARGET_LAG_14,TARGET_LAG_28:2"
_ROLL = "TARGET_ROLLING_MEAN_7, TARGET_ROLLING_MEAN_28, TARGET_STD_28, TARGET_NON_ZERO_RATIO_28"
_ROLL_DIGITS = "TARGET_ROLLING_MEAN_7,TARGET_ROLLING_MEAN_28,TARGET_STD_28:4 TARGET_NON_ZERO_RATIO_28:8"
_CAL = "DAY_OF_WEEK, DAY_OF_MONTH, IS_MONTH_END, IS_MONTH_START, IS_WEEKEND"


def _cols(text):
    return [c.strip() for c in text.split(",")]


def _pick(t, columns):
    return t.day_rows.select("CUTOFF_DATE", *_cols(columns))


@query("final_targets", "SELECT * FROM final_labels", "TARGET_AMOUNT:2")
def _(t):
    return D.final_targets(t.realized)


@query("labels_as_of", "SELECT VALUE_DATE AS DATE, sum(KNOWN_AMOUNT) AS TARGET_AMOUNT FROM known WHERE TRADE_DATE <= DATE '2000-02-15' GROUP BY 1", "TARGET_AMOUNT:2")
def _(t):
    return D.labels_as_of(t.known, "2000-02-15")


@query("available_panel", """SELECT c.DATE, coalesce(sum(k.KNOWN_AMOUNT), 0) AS TARGET_AMOUNT FROM calendar c LEFT JOIN known k
       ON k.VALUE_DATE = c.DATE AND k.TRADE_DATE <= DATE '2000-02-15' GROUP BY 1""", "TARGET_AMOUNT:2")
def _(t):
    return D.available_panel(t.known, t.calendar.select("DATE"), "2000-02-15")


@query("history_window", """SELECT CUTOFF_DATE, DATE AS VALUE_DATE, CUTOFF_DATE - DATE AS AGE, amt AS AMOUNT FROM panel WHERE amt <> 0""",
       "AMOUNT:2", "AGE")
def _(t):
    rows = D.as_of_rows(D.as_of_steps(t.known), SPEC.history - 1)
    lo, hi = t.span
    return rows.filter(F.col("CUTOFF_DATE").between(lo, F.date_sub(hi, 1))).filter("AGE >= 0 AND AMOUNT <> 0").select("CUTOFF_DATE", "VALUE_DATE", "AGE", "AMOUNT")


@query("join_as_of_range", """SELECT e.CUTOFF_DATE, k.VALUE_DATE, sum(k.KNOWN_AMOUNT) AS AMOUNT, sum(k.KNOWN_COUNT) AS N FROM eval_days e JOIN known k
       ON k.TRADE_DATE <= e.CUTOFF_DATE AND k.VALUE_DATE BETWEEN e.CUTOFF_DATE - 27 AND e.CUTOFF_DATE + 1 GROUP BY 1, 2""", "AMOUNT:2", "N")
def _(t):
    rows = D.as_of_rows(D.as_of_steps(t.known), 27)
    last = t.calendar.agg(F.max("DATE").alias("d")).scalar()
    return rows.filter((F.col("CUTOFF_DATE") < last) & (F.col("CUTOFF_DATE") >= t.calendar.agg(F.min("DATE")).scalar())).select(
        "CUTOFF_DATE", "VALUE_DATE", "AMOUNT", F.col("COUNT").alias("N"))


@query("target_lag", f"SELECT CUTOFF_DATE, {_LAGS} FROM day_rows", _LAG_DIGITS)
def _(t):
    return _pick(t, _LAGS)


@query("rolling_mean", "SELECT CUTOFF_DATE, TARGET_ROLLING_MEAN_7, TARGET_ROLLING_MEAN_28 FROM day_rows", "TARGET_ROLLING_MEAN_7,TARGET_ROLLING_MEAN_28:4")
def _(t):
    return _pick(t, "TARGET_ROLLING_MEAN_7, TARGET_ROLLING_MEAN_28")


@query("rolling_std", "SELECT CUTOFF_DATE, TARGET_STD_28 FROM day_rows", "TARGET_STD_28:4")
def _(t):
    return _pick(t, "TARGET_STD_28")


@query("rolling_non_zero_ratio", "SELECT CUTOFF_DATE, TARGET_NON_ZERO_RATIO_28 FROM day_rows", "TARGET_NON_ZERO_RATIO_28:8")
def _(t):
    return _pick(t, "TARGET_NON_ZERO_RATIO_28")


@query("known_d1", "SELECT CUTOFF_DATE, KNOWN_AMOUNT_D1, KNOWN_COUNT_D1 FROM day_rows", "KNOWN_AMOUNT_D1:2")
def _(t):
    return _pick(t, "KNOWN_AMOUNT_D1, KNOWN_COUNT_D1")


@query("calendar_features", f"SELECT CUTOFF_DATE, FORECAST_DATE, {_CAL} FROM day_rows")
def _(t):
    return _pick(t, f"FORECAST_DATE, {_CAL}")


@query("cross_movement_known", """SELECT g.ENTITY_SHORTNAME, g.CURRENCY_SHORTNAME, g.MOVEMENT_SCOPE, g.CUTOFF_DATE, sum(o.a) - max(g.a) AS CROSS_MOVEMENT_KNOWN_AMOUNT_D1, sum(o.n) - max(g.n) AS CROSS_MOVEMENT_KNOWN_COUNT_D1
       FROM (SELECT s.*, e.CUTOFF_DATE, coalesce(sum(KNOWN_AMOUNT), 0) AS a, coalesce(sum(KNOWN_COUNT), 0) AS n FROM (SELECT DISTINCT ENTITY_SHORTNAME, CURRENCY_SHORTNAME, MOVEMENT_SCOPE FROM known_grain) s
         CROSS JOIN eval_days e LEFT JOIN known_grain k ON k.ENTITY_SHORTNAME = s.ENTITY_SHORTNAME AND k.CURRENCY_SHORTNAME = s.CURRENCY_SHORTNAME
         AND k.MOVEMENT_SCOPE = s.MOVEMENT_SCOPE AND k.VALUE_DATE = e.FORECAST_DATE AND k.TRADE_DATE <= e.CUTOFF_DATE GROUP BY ALL) g
       JOIN (SELECT s.*, e.CUTOFF_DATE, coalesce(sum(KNOWN_AMOUNT), 0) AS a, coalesce(sum(KNOWN_COUNT), 0) AS n FROM (SELECT DISTINCT ENTITY_SHORTNAME, CURRENCY_SHORTNAME, MOVEMENT_SCOPE FROM known_grain) s
         CROSS JOIN eval_days e LEFT JOIN known_grain k ON k.ENTITY_SHORTNAME = s.ENTITY_SHORTNAME AND k.CURRENCY_SHORTNAME = s.CURRENCY_SHORTNAME
         AND k.MOVEMENT_SCOPE = s.MOVEMENT_SCOPE AND k.VALUE_DATE = e.FORECAST_DATE AND k.TRADE_DATE <= e.CUTOFF_DATE GROUP BY ALL) o
       ON o.ENTITY_SHORTNAME = g.ENTITY_SHORTNAME AND o.CURRENCY_SHORTNAME = g.CURRENCY_SHORTNAME AND o.CUTOFF_DATE = g.CUTOFF_DATE GROUP BY 1, 2, 3, 4""",
       "CROSS_MOVEMENT_KNOWN_AMOUNT_D1:2", "CROSS_MOVEMENT_KNOWN_COUNT_D1")
def _(t):
    features = D.dataset_build(t.realized_grain, t.known_grain, *t.span, SPEC, seq=GRAIN)
    return D.cross_movement_known(features).select(*GRAIN, "CUTOFF_DATE", "CROSS_MOVEMENT_KNOWN_AMOUNT_D1", "CROSS_MOVEMENT_KNOWN_COUNT_D1")


@query("dataset_time_series", f"SELECT CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, {_LAGS}, {_ROLL} FROM day_rows", f"TARGET_AMOUNT:2 {_LAG_DIGITS} {_ROLL_DIGITS}")
def _(t):
    spec = D.FeatureSpec(kind="time_series", history=28)
    return D.dataset_build(t.realized, t.known, *t.span, spec)


_TAB = f"CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, {_CAL}, {_LAGS}, {_ROLL}, KNOWN_AMOUNT_D1, KNOWN_COUNT_D1, 0.0::DOUBLE AS CROSS_MOVEMENT_KNOWN_AMOUNT_D1, 0 AS CROSS_MOVEMENT_KNOWN_COUNT_D1"
_TAB_DIGITS = f"TARGET_AMOUNT,KNOWN_AMOUNT_D1:2 {_LAG_DIGITS} {_ROLL_DIGITS}"


@query("dataset_tabular", f"SELECT {_TAB} FROM day_rows", _TAB_DIGITS)
def _(t):
    return t.day_rows


@query("dataset_build", """SELECT e.CUTOFF_DATE, e.FORECAST_DATE, coalesce(l.TARGET_AMOUNT, 0) AS TARGET_AMOUNT, coalesce(k.a, 0) AS KNOWN_AMOUNT_D1, coalesce(h.a, 0) AS TARGET_LAG_1
       FROM eval_days e LEFT JOIN final_labels l ON l.DATE = e.FORECAST_DATE
       LEFT JOIN (SELECT VALUE_DATE, sum(KNOWN_AMOUNT) AS a FROM known WHERE TRADE_DATE <= VALUE_DATE - 1 GROUP BY 1) k ON k.VALUE_DATE = e.FORECAST_DATE
       LEFT JOIN (SELECT VALUE_DATE, sum(KNOWN_AMOUNT) AS a FROM known WHERE TRADE_DATE <= VALUE_DATE GROUP BY 1) h ON h.VALUE_DATE = e.CUTOFF_DATE""", "TARGET_AMOUNT,KNOWN_AMOUNT_D1,TARGET_LAG_1:2")
def _(t):
    lo, hi = D.gold_calendar_bounds(t.realized, t.known)
    spec = D.FeatureSpec(lags=(1,), windows={}, calendar=False, cross=False)
    built = D.dataset_build(t.realized, t.known, lo, hi, spec)
    return built.select("CUTOFF_DATE", "FORECAST_DATE", "TARGET_AMOUNT", "KNOWN_AMOUNT_D1", "TARGET_LAG_1")


@query("dataset_manifest")
def _(t):
    return D.dataset_manifest(t.day_rows, SPEC, RULESET.ruleset_id)


@query("dataset_snapshot", f"""SELECT f.CUTOFF_DATE, f.FORECAST_DATE, coalesce(sum(k.KNOWN_AMOUNT), 0) AS TARGET_AMOUNT, {', '.join(f'any_value(f.{c}) AS {c}' for c in _cols(_LAGS))}
       FROM features f LEFT JOIN known k ON k.VALUE_DATE = f.FORECAST_DATE AND k.TRADE_DATE <= DATE '2000-03-31' GROUP BY 1, 2""", f"TARGET_AMOUNT:2 {_LAG_DIGITS}")
def _(t):
    from ..sources import layers as L

    path = L.scratch_path(t.spark, "snapshot")
    L.write_dataset(D.dataset_build(t.realized, t.known, *t.span, SPEC, label_as_of=EVAL_TO), path)
    return t.spark.read.parquet(path).select("CUTOFF_DATE", "FORECAST_DATE", "TARGET_AMOUNT", *_cols(_LAGS))


@query("numeric_features", f"SELECT CUTOFF_DATE, {', '.join(f'{c}::INT::DOUBLE AS {c}' for c in _cols(_CAL))}, {_LAGS}, {_ROLL}, KNOWN_AMOUNT_D1, KNOWN_COUNT_D1::DOUBLE AS KNOWN_COUNT_D1, 0.0::DOUBLE AS CROSS_MOVEMENT_KNOWN_AMOUNT_D1, 0.0::DOUBLE AS CROSS_MOVEMENT_KNOWN_COUNT_D1 FROM day_rows",
       f"KNOWN_AMOUNT_D1:2 {_LAG_DIGITS} {_ROLL_DIGITS}")
def _(t):
    return D.numeric_features(t.day_rows, keep=("CUTOFF_DATE",))


# --- target transforms ---


@query("transform_log1p", "SELECT FORECAST_DATE, ln(1 + abs(TARGET_AMOUNT)) AS z FROM day_rows", "z:8")
def _(t):
    return t.day_rows.select("FORECAST_DATE", X.log1p(F.abs("TARGET_AMOUNT")).alias("z"))


@query("transform_box_cox", "SELECT VALUE_DATE, (pow(abs(TARGET_AMOUNT) + 0.5, 0.3) - 1) / 0.3 AS z, ln(abs(TARGET_AMOUNT) + 0.5) AS z0 FROM realized", "z,z0:8")
def _(t):
    x, s = F.abs("TARGET_AMOUNT"), F.lit(0.5)
    return t.realized.select("VALUE_DATE", X.box_cox(x, F.lit(0.3), s).alias("z"), X.box_cox(x, F.lit(0.0), s).alias("z0"))


_YJ = "CASE WHEN x >= 0 THEN (pow(x + 1, 0.4) - 1) / 0.4 ELSE -(pow(1 - x, 1.6) - 1) / 1.6 END"


@query("transform_yeo_johnson", f"SELECT VALUE_DATE, {_YJ} AS z, CASE WHEN x >= 0 THEN ln(x + 1) ELSE -(pow(1 - x, 2) - 1) / 2 END AS z0 FROM (SELECT VALUE_DATE, TARGET_AMOUNT / 1000 AS x FROM realized)", "z,z0:4")
def _(t):
    x = F.col("TARGET_AMOUNT") / 1000
    return t.realized.select("VALUE_DATE", X.yeo_johnson(x, F.lit(0.4)).alias("z"), X.yeo_johnson(x, F.lit(0.0)).alias("z0"))


@query("inverse_transform", "SELECT VALUE_DATE, TARGET_AMOUNT AS yj, abs(TARGET_AMOUNT) AS bc, abs(TARGET_AMOUNT) AS lg FROM realized", "yj,bc,lg:2")
def _(t):
    x, p, s = F.col("TARGET_AMOUNT"), F.lit(0.4), F.lit(0.5)
    return t.realized.select(
        "VALUE_DATE",
        X.inverse("yeo_johnson", X.yeo_johnson(x, p), p).alias("yj"),
        X.inverse("box_cox", X.box_cox(F.abs(x), p, s), p, s).alias("bc"),
        X.inverse("log1p", X.log1p(F.abs(x))).alias("lg"))


@query("fit_box_cox")
def _(t):
    return X.fit_power(t.folds.training(()), "box_cox")


@query("fit_yeo_johnson")
def _(t):
    return X.fit_power(t.folds.training(()), "yeo_johnson")


@query("fold_transform_fit")
def _(t):
    return X.fold_features_in_fitted_units(t.folds, "yeo_johnson").groupBy("EVALUATION_CUTOFF").agg(
        F.max("POWER").alias("POWER"), F.avg("TARGET_AMOUNT").alias("MEAN_TARGET"), F.avg("TARGET_LAG_7").alias("MEAN_LAG_7"))


@query("transform_history_features", """SELECT e.CUTOFF_DATE, coalesce(max(z) FILTER (p.DATE = e.FORECAST_DATE - 7), 0) AS TARGET_LAG_7, avg(z) AS TARGET_ROLLING_MEAN_28, stddev_pop(z) AS TARGET_STD_28,
       any_value(sign(e.KNOWN_AMOUNT_D1) * ln(1 + abs(e.KNOWN_AMOUNT_D1))) AS KNOWN_AMOUNT_D1 FROM day_rows e JOIN (SELECT *, sign(amt) * ln(1 + abs(amt)) AS z FROM panel) p ON p.CUTOFF_DATE = e.CUTOFF_DATE GROUP BY 1""",
       "TARGET_LAG_7,TARGET_ROLLING_MEAN_28,TARGET_STD_28,KNOWN_AMOUNT_D1:6")
def _(t):
    scale = D.Rescale(lambda x: F.sign(x) * X.log1p(F.abs(x)), F.lit(0.0))
    return D.dataset_build(t.realized, t.known, *t.span, SPEC, scale=scale).select(
        "CUTOFF_DATE", "TARGET_LAG_7", "TARGET_ROLLING_MEAN_28", "TARGET_STD_28", "KNOWN_AMOUNT_D1")


_P = "CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, PREDICTION"


def _window_means(training, rows):
    """Mean training label of the fold, in whatever units it has."""
    means = training.groupBy("EVALUATION_CUTOFF").agg(F.avg("TARGET_AMOUNT").alias("PREDICTION"))
    return rows.join(means, "EVALUATION_CUTOFF")


def _positive_folds(t):
    """Folds over the size of the daily amounts, so that every transform is defined."""
    size = lambda df, c: df.withColumn(c, F.abs(c))
    return K.FoldData(size(t.realized, "TARGET_AMOUNT"), size(t.known, "KNOWN_AMOUNT"), EVAL_FROM, EVAL_TO, TRAIN_WINDOW, SPEC)


_ABS_LABEL = "coalesce((SELECT sum(abs(k.KNOWN_AMOUNT)) FROM known k WHERE k.VALUE_DATE = t.FORECAST_DATE AND k.TRADE_DATE <= t.EVALUATION_CUTOFF), 0)"


@query("backtest_log1p", f"""SELECT e.CUTOFF_DATE, e.FORECAST_DATE, abs(e.TARGET_AMOUNT) AS TARGET_AMOUNT, m.p AS PREDICTION FROM eval_rows e JOIN
       (SELECT EVALUATION_CUTOFF, exp(avg(ln(1 + y))) - 1 AS p FROM (SELECT t.EVALUATION_CUTOFF, {_ABS_LABEL} AS y FROM train_rows t) GROUP BY 1) m ON m.EVALUATION_CUTOFF = e.CUTOFF_DATE""",
       "TARGET_AMOUNT:2 PREDICTION:4")
def _(t):
    return X.transformed_backtest(_positive_folds(t), "log1p", _window_means).select(*_cols(_P))


@query("backtest_box_cox")
def _(t):
    from ..operators.learners import ridge

    names = ["TARGET_LAG_1", "TARGET_LAG_7", "TARGET_ROLLING_MEAN_28", "KNOWN_AMOUNT_D1"]
    return X.transformed_backtest(_positive_folds(t), "box_cox", lambda a, b: ridge(a, b, names)).select(*_cols(_P))


@query("backtest_yeo_johnson")
def _(t):
    from ..operators.learners import gbt_regressor

    return X.transformed_backtest(t.folds, "yeo_johnson", gbt_regressor).select(*_cols(_P))


# --- simple forecasts ---

def _predict(t, model, **kw):
    return model(t.folds.training(()), t.folds.inference(), **kw).select(*_cols(_P))


for _name, _model in (("naive_last_day", "naive_last_day"), ("seasonal_naive", "seasonal_naive_weekly"),
                      ("moving_average", "moving_average"), ("known_amount_d1", "known_amount_d1")):

    @query(f"model_{_name}", f"SELECT {_P} FROM preds WHERE RUN_NAME = '{_model}'", "TARGET_AMOUNT:2 PREDICTION:4")
    def _(t, model=_model):
        return _predict(t, M.BASELINES[model])


@query("training_series", """SELECT EVALUATION_CUTOFF, arg_max(TARGET_AMOUNT, FORECAST_DATE) AS LAST_VALUE, avg(TARGET_AMOUNT) AS MEAN_VALUE, count(*) AS TRAINING_ROWS,
       avg(TARGET_AMOUNT) FILTER (FORECAST_DATE > EVALUATION_CUTOFF - 14) AS MEAN_LAST_14 FROM train_rows GROUP BY 1""", "LAST_VALUE:2 MEAN_VALUE,MEAN_LAST_14:4")
def _(t):
    return K.training_stats(t.folds.training(()), last_n=14)


@query("daily_series_fill", "SELECT EVALUATION_CUTOFF, FORECAST_DATE, TARGET_AMOUNT AS Y FROM train_rows", "Y:2")
def _(t):
    return M.daily_series_fill(t.folds.training(()))


@query("model_croston")
def _(t):
    return _predict(t, M.croston)


@query("model_theta")
def _(t):
    return _predict(t, M.theta)


@query("model_imapa")
def _(t):
    return _predict(t, M.imapa)


@query("model_ar_lag", f"""SELECT CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, phi * last AS PREDICTION FROM eval_rows JOIN (
       SELECT EVALUATION_CUTOFF, sum(y * p) / sum(p * p) AS phi, arg_max(y, FORECAST_DATE) AS last FROM (SELECT *, TARGET_AMOUNT AS y, lag(TARGET_AMOUNT) OVER (PARTITION BY EVALUATION_CUTOFF ORDER BY FORECAST_DATE) AS p FROM train_rows) GROUP BY 1) m
       ON m.EVALUATION_CUTOFF = CUTOFF_DATE""", "TARGET_AMOUNT:2 PREDICTION:4")
def _(t):
    return _predict(t, M.ar_lag)


# --- rolling-origin evaluation ---


@query("fold_grid", "SELECT CUTOFF_DATE AS EVALUATION_CUTOFF, CUTOFF_DATE - 90 AS TRAIN_CUTOFF_START, CUTOFF_DATE - 1 AS TRAIN_CUTOFF_END FROM eval_days")
def _(t):
    lo, hi = t.span
    return K.fold_grid(t.spark, lo, F.date_sub(hi, 1), TRAIN_WINDOW)


@query("fold_training_set", f"SELECT EVALUATION_CUTOFF, CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, {_LAGS}, {_ROLL}, KNOWN_AMOUNT_D1 FROM train_rows",
       f"TARGET_AMOUNT,KNOWN_AMOUNT_D1:2 {_LAG_DIGITS} {_ROLL_DIGITS}")
def _(t):
    return t.folds.training().select("EVALUATION_CUTOFF", "CUTOFF_DATE", "FORECAST_DATE", "TARGET_AMOUNT", *_cols(_LAGS), *_cols(_ROLL), "KNOWN_AMOUNT_D1")


@query("fold_inference_set", f"SELECT CUTOFF_DATE AS EVALUATION_CUTOFF, FORECAST_DATE, TARGET_AMOUNT, {_LAGS}, KNOWN_AMOUNT_D1 FROM eval_rows", f"TARGET_AMOUNT,KNOWN_AMOUNT_D1:2 {_LAG_DIGITS}")
def _(t):
    return t.folds.inference().select("EVALUATION_CUTOFF", "FORECAST_DATE", "TARGET_AMOUNT", *_cols(_LAGS), "KNOWN_AMOUNT_D1")


_EDGE = "SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS E FROM (SELECT lo - 3 AS lo, hi + 40 AS hi FROM cal_bounds)"


@query("fold_skip_reasons", f"""SELECT CASE WHEN nt = 0 AND ni = 0 THEN 'empty_training_and_inference_data' WHEN nt = 0 THEN 'empty_training_data' WHEN ni = 0 THEN 'empty_inference_data' ELSE 'completed' END AS fold_state,
       count(*) AS folds, sum(nt) AS training_rows, sum(ni) AS inference_rows FROM (SELECT E, count(*) FILTER (d.CUTOFF_DATE BETWEEN E - 20 AND E - 1) AS nt, count(*) FILTER (d.CUTOFF_DATE = E) AS ni
       FROM ({_EDGE}) LEFT JOIN (SELECT DATE - 1 AS CUTOFF_DATE FROM calendar) d ON d.CUTOFF_DATE BETWEEN E - 20 AND E GROUP BY E) GROUP BY 1""", ints="training_rows inference_rows")
def _(t):
    data = _edge_folds(t)
    return K.fold_skip_reasons(data.folds, data.training_cutoffs(()), data.inference())


def _edge_folds(t):
    """Folds from before the first to after the last day of the data."""
    lo, hi = D.gold_calendar_bounds(t.realized, t.known)
    spec = D.FeatureSpec(lags=(1,), windows={}, calendar=False, cross=False)
    return K.FoldData(t.realized, t.known, F.date_sub(lo, 3), F.date_add(hi, 40), 20, spec)


@query("backtest_run", "SELECT RUN_NAME, CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, PREDICTION, abs(PREDICTION - TARGET_AMOUNT) AS ABS_ERROR, EVALUATION_CUTOFF, TRAIN_CUTOFF_START, TRAIN_CUTOFF_END FROM preds",
       "TARGET_AMOUNT:2 PREDICTION,ABS_ERROR:4")
def _(t):
    return t.predictions


@query("backtest_errors", "SELECT RUN_NAME, CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, PREDICTION, abs(PREDICTION - TARGET_AMOUNT) AS ABS_ERROR, EVALUATION_CUTOFF, TRAIN_CUTOFF_START, TRAIN_CUTOFF_END FROM preds",
       "TARGET_AMOUNT:2 PREDICTION,ABS_ERROR:4")
def _(t):
    return t.predictions


@query("backtest_run_report", """SELECT 91 AS cutoff_count, 91 AS completed_folds, 0 AS skipped_folds, (SELECT count(*) FROM train_rows) AS training_row_count, (SELECT count(*) FROM eval_rows) AS inference_row_count,
       (SELECT count(*) FROM preds WHERE RUN_NAME = 'moving_average') AS prediction_row_count""", ints="cutoff_count completed_folds skipped_folds training_row_count inference_row_count prediction_row_count")
def _(t):
    training, inference = t.folds.training(()), t.folds.inference()
    return K.backtest_run_report(t.folds.folds, training, inference, M.moving_average(training, inference))


@query("rank_runs", """SELECT RUN_NAME, count(*) AS prediction_rows, avg(e) AS mae, quantile_cont(e, 0.5) AS median_ae, quantile_cont(e, 0.9) AS p90_ae
       FROM (SELECT RUN_NAME, abs(PREDICTION - TARGET_AMOUNT) AS e FROM preds) GROUP BY 1""", "mae,median_ae,p90_ae:3")
def _(t):
    return K.rank_runs(t.predictions)
