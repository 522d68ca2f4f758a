"""Queries of scores, ceilings and forecast diagnostics, over every day of the calendar."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions.scoring import daily_score, weighted_score
from ..operators import evaluate as E
from ..operators import relational as R
from .registry import query

_FEATURES = ("DAY_OF_WEEK", "TARGET_LAG_1", "TARGET_LAG_7", "TARGET_LAG_14", "TARGET_LAG_28",
             "TARGET_ROLLING_MEAN_7", "TARGET_ROLLING_MEAN_28", "KNOWN_AMOUNT_D1")
_NEAR = ("DAY_OF_WEEK", "TARGET_LAG_1", "TARGET_LAG_7", "TARGET_ROLLING_MEAN_7", "TARGET_ROLLING_MEAN_28")
_ACTIONS = ("KNOWN_AMOUNT_D1", "TARGET_LAG_1", "TARGET_LAG_7", "TARGET_LAG_14", "TARGET_LAG_28",
            "TARGET_ROLLING_MEAN_7", "TARGET_ROLLING_MEAN_28")
_FRAME = "RUN_NAME, CUTOFF_DATE, FORECAST_DATE, TARGET_AMOUNT, PREDICTION, p AS PREDICTION_CLIPPED, score AS DAILY_BUSINESS_SCORE, gain AS WEIGHTED_SCORE_POINTS, pen AS WEIGHTED_PENALTY_POINTS"
_FRAME_DIGITS = "TARGET_AMOUNT:2 PREDICTION,PREDICTION_CLIPPED:5 DAILY_BUSINESS_SCORE:6 WEIGHTED_SCORE_POINTS,WEIGHTED_PENALTY_POINTS:3"
_FRAME_COLUMNS = ("RUN_NAME", "CUTOFF_DATE", "FORECAST_DATE", "TARGET_AMOUNT", "PREDICTION", "PREDICTION_CLIPPED",
                  "DAILY_BUSINESS_SCORE", "WEIGHTED_SCORE_POINTS", "WEIGHTED_PENALTY_POINTS")


@query("normalize_prediction_frame", f"SELECT {_FRAME}, 'simple' AS FAMILY FROM scored", _FRAME_DIGITS)
def _(t):
    raw = t.simple.select("RUN_NAME", "CUTOFF_DATE", "FORECAST_DATE", "TARGET_AMOUNT", "PREDICTION", "ABS_ERROR",
                                                                  "EVALUATION_CUTOFF", "TRAIN_CUTOFF_START", "TRAIN_CUTOFF_END")
    return E.normalize_prediction_frame(raw, F.col("RUN_NAME"), "simple").select(*_FRAME_COLUMNS, "FAMILY")


@query("simple_candidates", f"SELECT {_FRAME} FROM scored", _FRAME_DIGITS)
def _(t):
    return t.simple.select(*_FRAME_COLUMNS)


@query("daily_score", "SELECT RUN_NAME, FORECAST_DATE, score FROM scored", "score:6")
def _(t):
    return t.simple.select("RUN_NAME", "FORECAST_DATE", daily_score("TARGET_AMOUNT", "PREDICTION").alias("score"))


@query("weighted_score", "SELECT RUN_NAME, sum(gain) / sum(y) AS score FROM scored GROUP BY 1", "score:8")
def _(t):
    return t.simple.groupBy("RUN_NAME").agg(weighted_score("TARGET_AMOUNT", "PREDICTION").alias("score"))


_SCORES = """SELECT RUN_NAME, 'simple' AS FAMILY, sum(gain) / sum(y) AS WEIGHTED_BUSINESS_SCORE, avg(score) AS MEAN_DAILY_SCORE, 100 - sum(gain) / sum(y) AS AMOUNT_WEIGHTED_PENALTY, avg(abs(p - y)) AS MAE_CLIPPED,
 sum(y) AS TOTAL_ACTUAL_AMOUNT, count(*) AS ROWS FROM scored GROUP BY 1"""
_SCORE_DIGITS = "WEIGHTED_BUSINESS_SCORE,MEAN_DAILY_SCORE,AMOUNT_WEIGHTED_PENALTY:8 MAE_CLIPPED:4 TOTAL_ACTUAL_AMOUNT:2"


@query("score_summary", _SCORES, _SCORE_DIGITS)
def _(t):
    return E.score_summary(t.simple)


@query("prediction_manifest", "SELECT RUN_NAME, 'simple' AS FAMILY, count(*) AS ROWS, min(FORECAST_DATE) AS FORECAST_START, max(FORECAST_DATE) AS FORECAST_END FROM scored GROUP BY 1")
def _(t):
    return E.prediction_manifest(t.simple)


@query("hindsight_oracle", """SELECT FORECAST_DATE, RUN_NAME AS ORACLE_CHOSEN_RUN, PREDICTION, score AS DAILY_BUSINESS_SCORE FROM (SELECT *, row_number() OVER (PARTITION BY FORECAST_DATE ORDER BY round(score, 9) DESC, RUN_NAME DESC) AS rn FROM scored) WHERE rn = 1""",
       "PREDICTION:5 DAILY_BUSINESS_SCORE:6")
def _(t):
    return E.hindsight_oracle(t.simple).select("FORECAST_DATE", "ORACLE_CHOSEN_RUN", "PREDICTION", "DAILY_BUSINESS_SCORE")


_REFS = {"ZERO": "simple/zero", "KNOWN_D1": "simple/known_amount_d1", "WEEKLY_LAG7": "simple/target_lag_7"}


@query("forecast_value_added", f"""SELECT RUN_NAME, s, {', '.join(f"s - max(s) FILTER (RUN_NAME = '{r}') OVER () AS FVA_VS_{k}" for k, r in _REFS.items())}, s - max(s) OVER () AS FVA_VS_BEST_SIMPLE
       FROM (SELECT RUN_NAME, sum(gain) / sum(y) AS s FROM scored GROUP BY 1)""", "s,FVA_VS_ZERO,FVA_VS_KNOWN_D1,FVA_VS_WEEKLY_LAG7,FVA_VS_BEST_SIMPLE:8")
def _(t):
    return E.forecast_value_added(E.score_summary(t.simple), _REFS).select(
        "RUN_NAME", F.col("WEIGHTED_BUSINESS_SCORE").alias("s"), *[f"FVA_VS_{k}" for k in (*_REFS, "BEST_SIMPLE")])


@query("interval_coverage", """SELECT lvl AS COVERAGE_LEVEL, count(*) AS ROWS, avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS EMPIRICAL_COVERAGE, quantile_cont(hi - lo, 0.5) AS MEDIAN_INTERVAL_WIDTH, avg(hi - lo) AS MEAN_INTERVAL_WIDTH
       FROM (SELECT lvl, y, p * (1 - w) AS lo, p * (1 + w) AS hi FROM scored CROSS JOIN (VALUES ('80', 0.4), ('95', 0.9)) v(lvl, w) WHERE RUN_NAME = 'simple/rolling_mean_28') GROUP BY 1""",
       "EMPIRICAL_COVERAGE:8 MEDIAN_INTERVAL_WIDTH,MEAN_INTERVAL_WIDTH:3")
def _(t):
    base = t.simple.filter("RUN_NAME = 'simple/rolling_mean_28'")
    out = None
    for name, factor in (("quantile/80_lower", 0.6), ("quantile/80-upper", 1.4), ("q95/lower", 0.1), ("q95/upper", 1.9)):
        run = base.withColumns({"RUN_NAME": F.lit(name), "PREDICTION_CLIPPED": F.col("PREDICTION_CLIPPED") * factor})
        out = run if out is None else out.unionByName(run)
    return E.interval_coverage(out)


@query("amount_concentration", """SELECT s AS TOP_DAY_SHARE, k AS DAY_COUNT, sum(y) FILTER (r <= k) / sum(y) AS ACTUAL_AMOUNT_SHARE FROM (SELECT y, row_number() OVER (ORDER BY y DESC) AS r, s, greatest(1, CAST(round_even(count(*) OVER () * s, 0) AS BIGINT)) AS k
       FROM (SELECT greatest(TARGET_AMOUNT, 0) AS y FROM all_rows) CROSS JOIN (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(s) QUALIFY true) GROUP BY 1, 2""".replace("row_number() OVER (ORDER BY y DESC)", "row_number() OVER (PARTITION BY s ORDER BY y DESC)").replace("count(*) OVER ()", "count(*) OVER (PARTITION BY s)").replace(" QUALIFY true", ""),
       "TOP_DAY_SHARE:2 ACTUAL_AMOUNT_SHARE:8")
def _(t):
    return E.amount_concentration(t.all_rows)


@query("target_profile", """SELECT count(*) AS ROWS, min(FORECAST_DATE) AS FORECAST_START, max(FORECAST_DATE) AS FORECAST_END, avg((y > 0)::INT) AS ACTIVE_DAY_RATIO, avg((y = 0)::INT) AS ZERO_DAY_RATIO, sum(y) AS TOTAL_ACTUAL_AMOUNT,
       quantile_cont(y, 0.9) AS P90_ACTUAL_AMOUNT, quantile_cont(y, 0.95) AS P95_ACTUAL_AMOUNT, quantile_cont(y, 0.99) AS P99_ACTUAL_AMOUNT FROM (SELECT *, greatest(TARGET_AMOUNT, 0) AS y FROM all_rows)""",
       "ACTIVE_DAY_RATIO,ZERO_DAY_RATIO:8 TOTAL_ACTUAL_AMOUNT:2 P90_ACTUAL_AMOUNT,P95_ACTUAL_AMOUNT,P99_ACTUAL_AMOUNT:4")
def _(t):
    return E.target_profile(t.all_rows)


_KNOWN_DAILY = """SELECT a.FORECAST_DATE AS VALUE_DATE, any_value(a.TARGET_AMOUNT) AS TARGET_AMOUNT, coalesce(sum(KNOWN_AMOUNT) FILTER (TRADE_DATE <= a.CUTOFF_DATE), 0) AS KNOWN_AT_CUTOFF_AMOUNT, coalesce(sum(KNOWN_AMOUNT) FILTER (TRADE_DATE > a.CUTOFF_DATE), 0) AS LATE_AFTER_CUTOFF_AMOUNT,
 coalesce(sum(KNOWN_COUNT) FILTER (TRADE_DATE <= a.CUTOFF_DATE), 0) AS KNOWN_AT_CUTOFF_COUNT, coalesce(sum(KNOWN_COUNT) FILTER (TRADE_DATE > a.CUTOFF_DATE), 0) AS LATE_AFTER_CUTOFF_COUNT, a.CUTOFF_DATE FROM all_rows a LEFT JOIN known k ON k.VALUE_DATE = a.FORECAST_DATE GROUP BY a.FORECAST_DATE, a.CUTOFF_DATE"""


@query("known_at_cutoff_daily", _KNOWN_DAILY, "TARGET_AMOUNT,KNOWN_AT_CUTOFF_AMOUNT,LATE_AFTER_CUTOFF_AMOUNT:2", "KNOWN_AT_CUTOFF_COUNT LATE_AFTER_CUTOFF_COUNT")
def _(t):
    return E.known_at_cutoff_daily(t.realized, t.known, t.all_rows)


@query("known_at_cutoff_summary", f"""SELECT sum(abs(k)) / sum(y) AS KNOWN_ABS_COVERAGE_RATIO, sum(abs(l)) / sum(y) AS LATE_ABS_RATIO, count(*) FILTER (k <> 0) AS DAYS_WITH_KNOWN_D1_AMOUNT, avg((k <> 0)::INT) AS DAYS_WITH_KNOWN_D1_AMOUNT_RATIO,
       sum(CASE WHEN y > 0 THEN 100 * least(y, greatest(k, 0)) / greatest(y, k) * y ELSE 0 END) / sum(y) AS KNOWN_AMOUNT_D1_CLIENT_SCORE FROM (SELECT KNOWN_AT_CUTOFF_AMOUNT AS k, LATE_AFTER_CUTOFF_AMOUNT AS l, greatest(TARGET_AMOUNT, 0) AS y FROM ({_KNOWN_DAILY}))""",
       "KNOWN_ABS_COVERAGE_RATIO,LATE_ABS_RATIO,DAYS_WITH_KNOWN_D1_AMOUNT_RATIO,KNOWN_AMOUNT_D1_CLIENT_SCORE:8")
def _(t):
    return E.known_at_cutoff_summary(E.known_at_cutoff_daily(t.realized, t.known, t.all_rows))


_LONG = " UNION ALL ".join(f"SELECT '{f}' AS FEATURE, FORECAST_DATE, CAST({f} AS DOUBLE) AS X, greatest(TARGET_AMOUNT, 0) AS Y FROM all_rows" for f in _FEATURES)
_RANK = lambda v: f"rank() OVER (PARTITION BY FEATURE ORDER BY round({v}, 4)) + (count(*) OVER (PARTITION BY FEATURE, round({v}, 4)) - 1) / 2"


def _rounded(t):
    """Sums in any order differ in the last bits, which would break ties between equal days."""
    return t.all_rows.withColumns({c: F.round(c, 4) for c in (*_FEATURES[1:], "TARGET_AMOUNT")})


@query("feature_signal", f"""SELECT FEATURE, avg((X <> 0)::INT) AS NON_ZERO_RATIO, corr(X, Y) AS PEARSON_WITH_AMOUNT, corr(rx, ry) AS SPEARMAN_WITH_AMOUNT FROM (SELECT *, {_RANK('X')} AS rx, {_RANK('Y')} AS ry FROM ({_LONG})) GROUP BY 1""",
       "NON_ZERO_RATIO,PEARSON_WITH_AMOUNT,SPEARMAN_WITH_AMOUNT:8")
def _(t):
    return E.feature_signal(_rounded(t), _FEATURES)


_BIN = lambda v: f"ntile(10) OVER (PARTITION BY FEATURE ORDER BY round({v}, 4), FORECAST_DATE)"


@query("mutual_information", f"""SELECT FEATURE, sum(n / t * ln(n * t / (nx * ny))) AS MI_AMOUNT FROM (SELECT FEATURE, n, sum(n) OVER (PARTITION BY FEATURE) AS t, sum(n) OVER (PARTITION BY FEATURE, bx) AS nx, sum(n) OVER (PARTITION BY FEATURE, by_) AS ny
       FROM (SELECT FEATURE, bx, by_, CAST(count(*) AS DOUBLE) AS n FROM (SELECT FEATURE, {_BIN('X')} AS bx, {_BIN('Y')} AS by_ FROM ({_LONG})) GROUP BY 1, 2, 3)) GROUP BY 1""", "MI_AMOUNT:8")
def _(t):
    return E.binned_mutual_information(E.long_features(_rounded(t), _FEATURES))


@query("block_shuffle")
def _(t):
    return R.block_shuffle(t.all_rows, "FORECAST_DATE", "TARGET_AMOUNT", seed=1)


_SHARE_LIST = "(VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(s)"


@query("penalty_concentration", f"""SELECT RUN_NAME, s AS TOP_DAY_SHARE, k AS DAY_COUNT, sum(pen) FILTER (r <= k) / sum(pen) AS BUSINESS_PENALTY_SHARE, sum(y) FILTER (r <= k) / sum(y) AS ACTUAL_AMOUNT_SHARE
       FROM (SELECT *, greatest(1, CAST(round_even(n * s, 0) AS BIGINT)) AS k FROM worst CROSS JOIN {_SHARE_LIST} WHERE s > 0) GROUP BY 1, 2, 3""", "TOP_DAY_SHARE:2 BUSINESS_PENALTY_SHARE,ACTUAL_AMOUNT_SHARE:8")
def _(t):
    return E.penalty_concentration(t.simple)


@query("spike_penalty", """SELECT RUN_NAME, d AS SPIKE_DEFINITION, q AS THRESHOLD, avg((y >= q)::INT) AS DAY_SHARE, sum(y) FILTER (y >= q) / sum(y) AS ACTUAL_AMOUNT_SHARE, sum(pen) FILTER (y >= q) / sum(pen) AS BUSINESS_PENALTY_SHARE
       FROM scored JOIN (SELECT RUN_NAME, 'Q90' AS d, quantile_cont(y, 0.9) AS q FROM scored GROUP BY 1 UNION ALL SELECT RUN_NAME, 'Q95', quantile_cont(y, 0.95) FROM scored GROUP BY 1 UNION ALL SELECT RUN_NAME, 'Q99', quantile_cont(y, 0.99) FROM scored GROUP BY 1) USING (RUN_NAME) GROUP BY 1, 2, 3""",
       "THRESHOLD:3 DAY_SHARE,ACTUAL_AMOUNT_SHARE,BUSINESS_PENALTY_SHARE:8")
def _(t):
    return E.spike_penalty(t.simple)


@query("topk_worst_days", "SELECT RUN_NAME, FORECAST_DATE, TARGET_AMOUNT, PREDICTION, score AS DAILY_BUSINESS_SCORE, pen AS WEIGHTED_PENALTY_POINTS FROM scored ORDER BY round(pen, 4) DESC, FORECAST_DATE, RUN_NAME LIMIT 30",
       "TARGET_AMOUNT:2 PREDICTION:5 DAILY_BUSINESS_SCORE:6 WEIGHTED_PENALTY_POINTS:3")
def _(t):
    return E.worst_days(t.simple)


_MIN = "SELECT RUN_NAME, min(r) AS m FROM (SELECT RUN_NAME, r, cy, cg, ty, tg FROM worst UNION ALL SELECT RUN_NAME, 0, 0, 0, sum(y), sum(gain) FROM scored GROUP BY 1) WHERE ty - cy > 1e-9 AND (tg - cg) / (ty - cy) >= 80 GROUP BY 1"
_MIN_COLS = """m.m AS minimum_removed_days_to_reach_80, m.m / w.n AS minimum_removed_day_share_to_reach_80, CASE WHEN m.m = 0 THEN 0 ELSE x.cy / w.ty END AS minimum_removed_amount_share_to_reach_80, CASE WHEN m.m = 0 THEN 0 ELSE x.cp / w.tp END AS minimum_removed_penalty_share_to_reach_80"""
_MIN_FROM = f"(SELECT RUN_NAME, any_value(n) AS n, any_value(ty) AS ty, any_value(tp) AS tp FROM worst GROUP BY 1) w LEFT JOIN ({_MIN}) m ON m.RUN_NAME = w.RUN_NAME LEFT JOIN worst x ON x.RUN_NAME = m.RUN_NAME AND x.r = m.m"
_MIN_DIGITS = "minimum_removed_day_share_to_reach_80,minimum_removed_amount_share_to_reach_80,minimum_removed_penalty_share_to_reach_80:8"


@query("minimum_removed", f"SELECT w.RUN_NAME, {_MIN_COLS} FROM {_MIN_FROM}", _MIN_DIGITS)
def _(t):
    return E.minimum_removed(t.simple)


_EXCL = """(max(tg) - coalesce(sum(gain) FILTER ({c}), 0)) / nullif(max(ty) - coalesce(sum(y) FILTER ({c}), 0), 0) AS score_after_exclusion, count(*) FILTER ({c}) / count(*) AS removed_day_share, coalesce(sum(y) FILTER ({c}), 0) / max(ty) AS removed_amount_share,
 coalesce(sum(pen) FILTER ({c}), 0) / max(tp) AS removed_penalty_share, count(*) - count(*) FILTER ({c}) AS kept_rows"""
_EXCL_DIGITS = "score_after_exclusion:6 removed_day_share,removed_amount_share,removed_penalty_share:8"


@query("score_after_exclusion", f"SELECT RUN_NAME, {_EXCL.format(c='day(FORECAST_DATE) = 1')} FROM worst GROUP BY 1", _EXCL_DIGITS)
def _(t):
    return E.score_after_exclusion(t.simple, t.all_rows.filter(F.day("FORECAST_DATE") == 1))


@query("exclusion_curve_own", f"""SELECT c.*, z.* EXCLUDE (RUN_NAME) FROM (SELECT RUN_NAME, s AS SHARE, {_EXCL.format(c='r <= k')} FROM (SELECT *, CAST(round_even(n * s, 0) AS BIGINT) AS k FROM worst CROSS JOIN {_SHARE_LIST}) GROUP BY 1, 2) c
       JOIN (SELECT w.RUN_NAME, {_MIN_COLS} FROM {_MIN_FROM}) z ON z.RUN_NAME = c.RUN_NAME""", f"SHARE:2 {_EXCL_DIGITS} {_MIN_DIGITS}")
def _(t):
    return E.exclusion_curve_own(t.simple)


@query("exclusion_curve_shared", f"""SELECT RUN_NAME, s AS SHARE, {_EXCL.format(c='rr <= k')} FROM (SELECT w.*, x.r AS rr, s, CAST(round_even(w.n * s, 0) AS BIGINT) AS k FROM worst w JOIN worst x ON x.FORECAST_DATE = w.FORECAST_DATE AND x.RUN_NAME = 'simple/rolling_mean_28' CROSS JOIN {_SHARE_LIST}) GROUP BY 1, 2""",
       f"SHARE:2 {_EXCL_DIGITS}")
def _(t):
    return E.exclusion_curve_shared(t.simple, "simple/rolling_mean_28")


@query("residual_variance", "SELECT RUN_NAME, var_pop(y) AS VAR_ACTUAL, var_pop(y - p) AS VAR_RESIDUAL, var_pop(y - p) / var_pop(y) AS RESIDUAL_VARIANCE_RATIO, 1 - var_pop(y - p) / var_pop(y) AS EXPLAINED_VARIANCE_STYLE_SCORE FROM scored GROUP BY 1",
       "VAR_ACTUAL,VAR_RESIDUAL:-2 RESIDUAL_VARIANCE_RATIO,EXPLAINED_VARIANCE_STYLE_SCORE:8")
def _(t):
    return E.residual_variance(t.simple)


@query("residual_diagnostics")
def _(t):
    return E.residual_diagnostics(t.simple)


@query("residual_moments", """SELECT RUN_NAME, TEST, VALUE FROM (UNPIVOT (SELECT RUN_NAME, avg(r) AS "mean residual", median(r) AS "median residual",
       corr(r, l1) AS "lag1 residual autocorrelation", corr(r, l7) AS "lag7 residual autocorrelation" FROM (SELECT RUN_NAME, p - y AS r, lag(p - y, 1) OVER w AS l1, lag(p - y, 7) OVER w AS l7
       FROM scored WINDOW w AS (PARTITION BY RUN_NAME ORDER BY FORECAST_DATE)) GROUP BY 1) ON COLUMNS(* EXCLUDE RUN_NAME) INTO NAME TEST VALUE VALUE)""", "VALUE:4")
def _(t):
    return E.residual_diagnostics(t.simple).filter("TEST NOT LIKE 'Ljung%'")


@query("ljung_box_statistics", """SELECT RUN_NAME, LAGS, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - k)) AS STATISTIC FROM
       (SELECT a.RUN_NAME, k, any_value(a.n) AS n, sum(a.x * b.x) / any_value(a.v) AS r FROM (SELECT *, sum(x * x) OVER (PARTITION BY RUN_NAME) AS v FROM ljung) a
       JOIN (SELECT unnest(range(1, 29)) AS k) g ON true JOIN ljung b ON b.RUN_NAME = a.RUN_NAME AND b.i = a.i - k GROUP BY 1, 2), (VALUES (7), (14), (28)) h(LAGS) WHERE k <= LAGS GROUP BY 1, 2""", "STATISTIC:3")
def _(t):
    residual = t.simple.select("RUN_NAME", "FORECAST_DATE", (E.clipped("PREDICTION") - E.clipped("TARGET_AMOUNT")).alias("R"))
    return E.ljung_box_test(residual, "R").select("RUN_NAME", "LAGS", "STATISTIC")


@query("spectral_entropy", """SELECT h AS SPECTRAL_ENTROPY, 1 - h AS FORECASTABILITY_OMEGA FROM (SELECT -sum(p / t * ln(p / t + 1e-12)) / ln(count(*)) AS h FROM (SELECT p, sum(p) OVER () AS t FROM (SELECT k, pow(sum(x * cos(2 * pi() * ((k * i) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((k * i) % n) / n)), 2) AS p
       FROM (SELECT TARGET_AMOUNT - avg(TARGET_AMOUNT) OVER () AS x, row_number() OVER (ORDER BY FORECAST_DATE) - 1 AS i, count(*) OVER () AS n FROM all_rows), LATERAL (SELECT unnest(generate_series(1, n // 2)) AS k) g GROUP BY k)))""", "SPECTRAL_ENTROPY,FORECASTABILITY_OMEGA:8")
def _(t):
    return E.spectral_entropy(t.all_rows)


_STATE = "concat(DAY_OF_WEEK, '|lag7=', CASE WHEN TARGET_LAG_7 > 0 THEN 'True' ELSE 'False' END, '|lag28=', CASE WHEN TARGET_LAG_28 > 0 THEN 'True' ELSE 'False' END)"
_TASKS = f"""SELECT STATE, TASK, CASE TASK WHEN 'occurrence' THEN CASE WHEN y > 0 THEN 'active' ELSE 'zero' END WHEN 'spike_q90' THEN CASE WHEN y >= q90 THEN 'spike' ELSE 'normal' END
 ELSE CASE WHEN y <= 0 THEN 'zero' WHEN y <= q50 THEN 'small' WHEN y <= q75 THEN 'medium' WHEN y <= q90 THEN 'large' ELSE 'spike' END END AS LABEL
 FROM (SELECT {_STATE} AS STATE, greatest(TARGET_AMOUNT, 0) AS y FROM all_rows), (SELECT quantile_cont(greatest(TARGET_AMOUNT, 0), 0.5) AS q50, quantile_cont(greatest(TARGET_AMOUNT, 0), 0.75) AS q75, quantile_cont(greatest(TARGET_AMOUNT, 0), 0.9) AS q90 FROM all_rows), (VALUES ('occurrence'), ('spike_q90'), ('amount_bucket')) v(TASK)"""
_HY = f"SELECT TASK, count(*) AS CLASSES, -sum(n / t * log2(n / t)) AS h FROM (SELECT TASK, LABEL, count(*) AS n, sum(count(*)) OVER (PARTITION BY TASK) AS t FROM ({_TASKS}) GROUP BY TASK, LABEL) GROUP BY TASK"
_HC = f"SELECT TASK, -sum(n / tt * log2(n / t)) AS hc FROM (SELECT TASK, STATE, LABEL, count(*) AS n, sum(count(*)) OVER (PARTITION BY TASK, STATE) AS t, sum(count(*)) OVER (PARTITION BY TASK) AS tt FROM ({_TASKS}) GROUP BY TASK, STATE, LABEL) GROUP BY TASK"


@query("state_signature", f"SELECT FORECAST_DATE, {_STATE} AS STATE FROM all_rows")
def _(t):
    return t.all_rows.select("FORECAST_DATE", E.state_signature().alias("STATE"))


@query("entropy_bits", f"SELECT a.TASK, CLASSES, h AS H_BITS, hc AS H_GIVEN_BITS FROM ({_HY}) a JOIN ({_HC}) b ON a.TASK = b.TASK", "H_BITS,H_GIVEN_BITS:8")
def _(t):
    labels = E.task_labels(t.all_rows)
    own = E.entropy_bits(labels, "LABEL", ["TASK"]).drop("ROWS")
    return own.join(E.conditional_entropy_bits(labels, "LABEL", "STATE", ["TASK"]), "TASK")


@query("fano_bound", f"""SELECT a.TASK, CLASSES, h AS H_Y_BITS, hc AS H_Y_GIVEN_AVAILABLE_STATE_BITS, h - hc AS MUTUAL_INFORMATION_BITS, e AS FANO_ERROR_LOWER_BOUND, 1 - e AS FANO_ACCURACY_UPPER_BOUND FROM (SELECT x.*, (CASE WHEN CLASSES <= 1 OR hc <= 0 THEN 0 ELSE
       (SELECT coalesce(min(p), max(p)) FROM (SELECT (1 - 1 / CLASSES) * i / 10000 AS p FROM range(10001) g(i)) WHERE (CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END) + p * log2(greatest(CLASSES - 1, 1)) >= hc) END) AS e
       FROM (SELECT a.TASK, CLASSES, h, hc FROM ({_HY}) a JOIN ({_HC}) b ON a.TASK = b.TASK) x) a""", "H_Y_BITS,H_Y_GIVEN_AVAILABLE_STATE_BITS,MUTUAL_INFORMATION_BITS,FANO_ERROR_LOWER_BOUND,FANO_ACCURACY_UPPER_BOUND:8")
def _(t):
    return E.entropy_fano(t.all_rows)


@query("analog_optimizer")
def _(t):
    return E.analog_optimizer(t.all_rows, _NEAR, _ACTIONS)


@query("conditional_variance")
def _(t):
    return E.conditional_variance(E.analog_optimizer(t.all_rows, _NEAR, _ACTIONS))


@query("block_bootstrap")
def _(t):
    return E.bootstrap_interval(E.block_bootstrap(t.simple.filter("RUN_NAME = 'simple/rolling_mean_28'")))


@query("score_ladder")
def _(t):
    models = E.normalize_prediction_frame(t.predictions)
    return E.score_ladder(t.simple, models)


# --- run names ---

_RUN_NAMES = ("S/Quantile/80_lower", "known_amount_d1", "Naive_last_day", "moving_average", "auto_arima", "croston", "zero_aware_gbt",
              "spike_cascade", "stacking_ensemble", "lightgbm_log1p", "xgb", "gbt", "q95-UPPER", "run/95/lower")
_NAMED = f"SELECT e.event_id, list_element(['" + "', '".join(_RUN_NAMES) + f"'], CAST(e.event_id % {len(_RUN_NAMES)} AS INT) + 1) AS run FROM events e"


def _runs(t):
    names = F.array(*[F.lit(n) for n in _RUN_NAMES])
    return t.table("events").select("event_id", F.get(names, (F.col("event_id") % len(_RUN_NAMES)).cast("int")).alias("run"))


@query("infer_run_family", f"SELECT event_id, run, CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(run), '{k}')" for k in keys) + f" THEN '{family}'" for family, keys in B.RUN_FAMILIES) + f" ELSE 'other' END AS family FROM ({_NAMED})")
def _(t):
    return _runs(t).withColumn("family", B.infer_run_family("run"))


@query("quantile_role", f"""SELECT event_id, CASE WHEN c <> '' AND s IS NOT NULL THEN c END AS coverage, CASE WHEN c <> '' AND s IS NOT NULL THEN s END AS side FROM (SELECT event_id, regexp_extract(lower(run), '(80|95)', 1) AS c,
       CASE WHEN contains(lower(run), 'lower') THEN 'lower' WHEN contains(lower(run), 'upper') THEN 'upper' END AS s FROM ({_NAMED}))""")
def _(t):
    return _runs(t).withColumn("_r", B.quantile_role("run")).select("event_id", "_r.coverage", "_r.side")


@query("join_knn_history", f"""SELECT CUTOFF_DATE, NEIGHBOUR, d AS DISTANCE FROM (SELECT a.CUTOFF_DATE, b.CUTOFF_DATE AS NEIGHBOUR, sqrt({' + '.join(f'pow((b.{f} - a.{f}) / coalesce(nullif(a.{f}_s, 0), 1), 2)' for f in _NEAR)}) AS d,
       row_number() OVER (PARTITION BY a.CUTOFF_DATE ORDER BY sqrt({' + '.join(f'pow((b.{f} - a.{f}) / coalesce(nullif(a.{f}_s, 0), 1), 2)' for f in _NEAR)}), b.CUTOFF_DATE DESC) AS r
       FROM (SELECT *, {', '.join(f'stddev_pop({f}) OVER (ORDER BY CUTOFF_DATE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {f}_s' for f in _NEAR)}, row_number() OVER (ORDER BY CUTOFF_DATE) - 1 AS h FROM all_rows) a JOIN all_rows b ON b.CUTOFF_DATE < a.CUTOFF_DATE WHERE a.h >= 180) WHERE r <= 5""",
       "DISTANCE:6")
def _(t):
    return R.nearest_earlier(t.all_rows, "CUTOFF_DATE", _NEAR, k=5, min_history=180).select("CUTOFF_DATE", "NEIGHBOUR", "DISTANCE")


@query("win_history_standardize", f"""SELECT CUTOFF_DATE, row_number() OVER (ORDER BY CUTOFF_DATE) - 1 AS HISTORY_ROWS, avg(TARGET_LAG_7) OVER w + 3e-7 AS TARGET_LAG_7_MEAN, stddev_pop(TARGET_LAG_7) OVER w AS TARGET_LAG_7_STD
       FROM all_rows WINDOW w AS (ORDER BY CUTOFF_DATE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "TARGET_LAG_7_MEAN:6 TARGET_LAG_7_STD:4")
def _(t):
    return R.history_moments(t.all_rows.select("CUTOFF_DATE", "TARGET_LAG_7"), "CUTOFF_DATE", ["TARGET_LAG_7"]).drop("TARGET_LAG_7").withColumn("TARGET_LAG_7_MEAN", F.col("TARGET_LAG_7_MEAN") + 3e-7)
