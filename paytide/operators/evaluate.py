"""Scores, ceilings and diagnostics of prediction tables.

A prediction table has one row per run and day, so windows per run are bounded by the calendar.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import infer_run_family, ladder, quantile_role
from ..functions.scoring import clipped, daily_score, weighted_score
from .backtest import ABS_ERROR, EVAL, PREDICTION, PREDICTION_COLUMNS, TRAIN_FROM, TRAIN_TO
from .gold import KNOWN, KNOWN_COUNT, TARGET, TRADE, VALUE
from .pointintime import CUTOFF, FORECAST
from .quantiles import attach
from .relational import common_values, nearest_earlier, top_share_of_rows

RUN, FAMILY, SCORE = "RUN_NAME", "FAMILY", "DAILY_BUSINESS_SCORE"
GAIN, PENALTY = "WEIGHTED_SCORE_POINTS", "WEIGHTED_PENALTY_POINTS"
TARGET_SCORE = 80.0
SHARES = (0.01, 0.02, 0.05, 0.10, 0.20)


def normalize_prediction_frame(df: DataFrame, run: Column | str = RUN, family: str | None = None) -> DataFrame:
    """Typed prediction rows with scores; a forecast that is not for the next day is an error."""
    absent = [c for c in PREDICTION_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"prediction columns are absent: {absent}")
    run = F.col(run) if isinstance(run, str) else run
    days = {c: F.col(c).cast("date") for c in (CUTOFF, FORECAST, EVAL, TRAIN_FROM, TRAIN_TO)}
    typed = df.withColumns(
        days
        | {
            TARGET: F.coalesce(F.col(TARGET).cast("double"), F.lit(0.0)),
            PREDICTION: F.coalesce(F.col(PREDICTION).cast("double"), F.lit(0.0)),
            RUN: run,
        }
    ).filter(F.col(CUTOFF).isNotNull() & F.col(FORECAST).isNotNull())
    next_day = F.datediff(FORECAST, CUTOFF) == 1
    checked = F.when(next_day, F.col(FORECAST)).otherwise(F.raise_error(F.lit("forecast is not for cutoff + 1")))
    score, y = daily_score(TARGET, PREDICTION), clipped(TARGET)
    return typed.withColumns(
        {
            FORECAST: checked,
            ABS_ERROR: F.coalesce(F.col(ABS_ERROR).cast("double"), F.abs(F.col(PREDICTION) - F.col(TARGET))),
            FAMILY: F.lit(family) if family else infer_run_family(RUN),
            "PREDICTION_CLIPPED": clipped(PREDICTION),
            SCORE: score,
            GAIN: y * score,
            PENALTY: y * (100.0 - score),
        }
    )


def score_summary(frames: DataFrame, keys=(RUN, FAMILY)) -> DataFrame:
    weighted = weighted_score(TARGET, PREDICTION)
    return frames.groupBy(*keys).agg(
        weighted.alias("WEIGHTED_BUSINESS_SCORE"),
        F.avg(daily_score(TARGET, PREDICTION)).alias("MEAN_DAILY_SCORE"),
        (100.0 - weighted).alias("AMOUNT_WEIGHTED_PENALTY"),
        F.avg(F.abs(clipped(PREDICTION) - clipped(TARGET))).alias("MAE_CLIPPED"),
        F.sum(clipped(TARGET)).alias("TOTAL_ACTUAL_AMOUNT"),
        F.count("*").alias("ROWS"),
    )


# Run names of the simple candidates and the feature each one forecasts with.
SIMPLE_CANDIDATES = {
    "simple/known_amount_d1": "KNOWN_AMOUNT_D1",
    "simple/target_lag_1": "TARGET_LAG_1",
    "simple/target_lag_7": "TARGET_LAG_7",
    "simple/target_lag_14": "TARGET_LAG_14",
    "simple/target_lag_28": "TARGET_LAG_28",
    "simple/rolling_mean_7": "TARGET_ROLLING_MEAN_7",
    "simple/rolling_mean_28": "TARGET_ROLLING_MEAN_28",
}


def simple_candidates(features: DataFrame) -> DataFrame:
    """Feature columns unpivoted to runs, plus a run that always says zero."""
    named = {run: F.col(c) if c in features.columns else F.lit(0.0) for run, c in SIMPLE_CANDIDATES.items()}
    named["simple/zero"] = F.lit(0.0)
    wide = features.select(CUTOFF, FORECAST, TARGET, *[F.coalesce(c, F.lit(0.0)).alias(run) for run, c in named.items()])
    quoted = [F.col(f"`{run}`") for run in named]
    long = wide.unpivot([CUTOFF, FORECAST, TARGET], quoted, RUN, PREDICTION)
    empty = F.lit(None).cast("date")
    full = long.withColumns(
        {ABS_ERROR: F.abs(F.col(PREDICTION) - F.col(TARGET)), EVAL: F.col(CUTOFF), TRAIN_FROM: empty, TRAIN_TO: empty}
    )
    return normalize_prediction_frame(full, RUN, "simple")


def prediction_manifest(frames: DataFrame) -> DataFrame:
    return frames.groupBy(RUN, FAMILY).agg(
        F.count("*").alias("ROWS"), F.min(FORECAST).alias("FORECAST_START"), F.max(FORECAST).alias("FORECAST_END")
    )


def hindsight_oracle(frames: DataFrame) -> DataFrame:
    """Best run of each day that all runs have; the run name decides ties."""
    common = frames.join(common_values(frames, FORECAST, RUN), FORECAST, "left_semi")
    best = F.max_by(F.struct(CUTOFF, TARGET, PREDICTION, F.col(RUN).alias("ORACLE_CHOSEN_RUN"), SCORE),
                    F.struct(F.round(SCORE, 9), RUN))
    return common.groupBy(FORECAST).agg(best.alias("b")).select(FORECAST, "b.*")


def forecast_value_added(scores: DataFrame, references: dict[str, str]) -> DataFrame:
    """Score minus the score of each reference run: {label: run name}; BEST is the best run of all."""
    s = "WEIGHTED_BUSINESS_SCORE"
    out = scores
    for label, run in references.items():
        ref = scores.filter(F.col(RUN) == run).agg(F.max(s)).scalar()
        out = out.withColumn(f"FVA_VS_{label}", F.col(s) - ref)
    return out.withColumn("FVA_VS_BEST_SIMPLE", F.col(s) - scores.agg(F.max(s)).scalar())


def interval_coverage(frames: DataFrame) -> DataFrame:
    """Lower and upper runs of a coverage level side by side: one grouped pivot, no self-join."""
    tagged = frames.withColumn("_role", quantile_role(RUN)).filter("_role IS NOT NULL")
    side = lambda name, c: F.max(F.when(F.col("_role.side") == name, F.col(c)))
    pairs = tagged.groupBy(F.col("_role.coverage").alias("COVERAGE_LEVEL"), FORECAST).agg(
        F.max(clipped(TARGET)).alias("y"),
        side("lower", "PREDICTION_CLIPPED").alias("lo"),
        side("upper", "PREDICTION_CLIPPED").alias("hi"),
    ).filter("lo IS NOT NULL AND hi IS NOT NULL")
    width = F.col("hi") - F.col("lo")
    return pairs.groupBy("COVERAGE_LEVEL").agg(
        F.count("*").alias("ROWS"),
        F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("EMPIRICAL_COVERAGE"),
        F.percentile(width, 0.5).alias("MEDIAN_INTERVAL_WIDTH"),
        F.avg(width).alias("MEAN_INTERVAL_WIDTH"),
    )


def amount_concentration(features: DataFrame, shares=SHARES) -> DataFrame:
    days = features.select(FORECAST, clipped(TARGET).alias("_y"))
    return top_share_of_rows(days, "_y", FORECAST, shares, "_y")


def target_profile(features: DataFrame) -> DataFrame:
    y = clipped(TARGET)
    return features.agg(
        F.count("*").alias("ROWS"),
        F.min(FORECAST).alias("FORECAST_START"),
        F.max(FORECAST).alias("FORECAST_END"),
        F.avg((y > 0).cast("double")).alias("ACTIVE_DAY_RATIO"),
        F.avg((y == 0).cast("double")).alias("ZERO_DAY_RATIO"),
        F.sum(y).alias("TOTAL_ACTUAL_AMOUNT"),
        *[F.percentile(y, q).alias(f"P{round(q * 100)}_ACTUAL_AMOUNT") for q in (0.90, 0.95, 0.99)],
    )


def known_at_cutoff_daily(realized: DataFrame, known: DataFrame, days: DataFrame) -> DataFrame:
    """Realized, known-in-time and late amounts of each forecast day."""
    base = days.select(F.col(FORECAST).alias(VALUE)).distinct()
    daily = realized.groupBy(VALUE).agg(F.sum(TARGET).alias(TARGET))
    in_time = F.col(TRADE) <= F.date_sub(VALUE, 1)
    parts = known.groupBy(VALUE).agg(
        *[
            F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name)
            for name, cond, c in (
                ("KNOWN_AT_CUTOFF_AMOUNT", in_time, KNOWN),
                ("LATE_AFTER_CUTOFF_AMOUNT", ~in_time, KNOWN),
                ("KNOWN_AT_CUTOFF_COUNT", in_time, KNOWN_COUNT),
                ("LATE_AFTER_CUTOFF_COUNT", ~in_time, KNOWN_COUNT),
            )
        ]
    )
    out = base.join(daily, VALUE, "left").join(parts, VALUE, "left")
    return out.fillna(0).withColumn(CUTOFF, F.date_sub(VALUE, 1))


def known_at_cutoff_summary(daily: DataFrame) -> DataFrame:
    total = F.sum(clipped(TARGET))
    has = F.col("KNOWN_AT_CUTOFF_AMOUNT") != 0
    return daily.agg(
        (F.sum(F.abs("KNOWN_AT_CUTOFF_AMOUNT")) / total).alias("KNOWN_ABS_COVERAGE_RATIO"),
        (F.sum(F.abs("LATE_AFTER_CUTOFF_AMOUNT")) / total).alias("LATE_ABS_RATIO"),
        F.count_if(has).alias("DAYS_WITH_KNOWN_D1_AMOUNT"),
        F.avg(has.cast("double")).alias("DAYS_WITH_KNOWN_D1_AMOUNT_RATIO"),
        weighted_score(TARGET, "KNOWN_AT_CUTOFF_AMOUNT").alias("KNOWN_AMOUNT_D1_CLIENT_SCORE"),
    )


def average_rank(value: str, keys=()) -> Column:
    """1-based rank with ties averaged, per key over one row per day."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(ordered) + (ties - 1) / 2


def long_features(features: DataFrame, names) -> DataFrame:
    wide = features.select(FORECAST, clipped(TARGET).alias("Y"),
                           *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    return wide.unpivot([FORECAST, "Y"], list(names), "FEATURE", "X")


def feature_signal(features: DataFrame, names) -> DataFrame:
    """Non-zero ratio, Pearson and Spearman of each feature with the amount."""
    long = long_features(features, names)
    ranked = long.withColumns({"RX": average_rank("X", ["FEATURE"]), "RY": average_rank("Y", ["FEATURE"])})
    varies = F.countDistinct("X") > 1
    return ranked.groupBy("FEATURE").agg(
        F.avg((F.col("X") != 0).cast("double")).alias("NON_ZERO_RATIO"),
        F.when(varies, F.corr("X", "Y")).alias("PEARSON_WITH_AMOUNT"),
        F.when(varies, F.corr("RX", "RY")).alias("SPEARMAN_WITH_AMOUNT"),
    )


def binned_mutual_information(long: DataFrame, bins: int = 10, keys=("FEATURE",)) -> DataFrame:
    """Mutual information in nats between equal-frequency bins of X and Y, from grouped counts."""
    keys = list(keys)
    slot = lambda c: F.ntile(bins).over(Window.partitionBy(*keys).orderBy(c, FORECAST))
    binned = long.select(*keys, slot("X").alias("BX"), slot("Y").alias("BY"))
    joint = binned.groupBy(*keys, "BX", "BY").agg(F.count("*").alias("n"))
    x = joint.groupBy(*keys, "BX").agg(F.sum("n").alias("nx"))
    y = joint.groupBy(*keys, "BY").agg(F.sum("n").alias("ny"))
    total = joint.groupBy(*keys).agg(F.sum("n").alias("t"))
    cells = joint.join(x, [*keys, "BX"]).join(y, [*keys, "BY"]).join(total, keys)
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return cells.groupBy(*keys).agg(F.sum(term).alias("MI_AMOUNT"))


def penalty_concentration(frames: DataFrame, shares=SHARES) -> DataFrame:
    """Penalty and amount share of each run's worst days."""
    return worst_day_sums(frames, shares, minimum=1).select(
        RUN, F.col("SHARE").alias("TOP_DAY_SHARE"), F.col("N").alias("DAY_COUNT"),
        (F.col("PENALTY_REMOVED") / F.col("PENALTY_TOTAL")).alias("BUSINESS_PENALTY_SHARE"),
        (F.col("AMOUNT_REMOVED") / F.col("AMOUNT_TOTAL")).alias("ACTUAL_AMOUNT_SHARE"),
    )


def worst_first(frames: DataFrame) -> DataFrame:
    """Per run: days ranked by penalty with running sums."""
    ordered = Window.partitionBy(RUN).orderBy(F.desc(F.round(PENALTY, 4)), FORECAST)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return frames.select(
        RUN, FORECAST, clipped(TARGET).alias("_y"), GAIN, PENALTY,
        F.row_number().over(ordered).alias("_r"),
        F.sum(clipped(TARGET)).over(running).alias("_cy"),
        F.sum(GAIN).over(running).alias("_cg"),
        F.sum(PENALTY).over(running).alias("_cp"),
    )


def run_totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy(RUN).agg(
        F.count("*").alias("ROW_TOTAL"), F.sum(clipped(TARGET)).alias("AMOUNT_TOTAL"),
        F.sum(GAIN).alias("GAIN_TOTAL"), F.sum(PENALTY).alias("PENALTY_TOTAL"),
    )


def worst_day_sums(frames: DataFrame, shares, minimum: int = 0, reference: str | None = None) -> DataFrame:
    """Per run and share: what the worst days hold (own worst days, or those of a reference run)."""
    totals = run_totals(frames)
    ranked = worst_first(frames)
    if reference is not None:
        order = ranked.filter(F.col(RUN) == reference).select(FORECAST, F.col("_r").alias("_ref"))
        rows = totals.filter(F.col(RUN) == reference).select("ROW_TOTAL").scalar()
        ranked = ranked.join(order, FORECAST).withColumn("_r", F.col("_ref"))
        totals = totals.withColumn("_n", rows)
    else:
        totals = totals.withColumn("_n", F.col("ROW_TOTAL"))
    points = totals.withColumn("SHARE", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    points = points.withColumn("N", F.greatest(F.lit(minimum), F.bround(F.col("_n") * F.col("SHARE"), 0).cast("bigint")))
    inside = F.col("_r") <= F.col("N")
    part = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0.0))
    return points.join(ranked, RUN).groupBy(RUN, "SHARE", "N", *[c for c in totals.columns if c.endswith("TOTAL")]).agg(
        F.count_if(inside).alias("ROWS_REMOVED"), part("_y").alias("AMOUNT_REMOVED"),
        part(GAIN).alias("GAIN_REMOVED"), part(PENALTY).alias("PENALTY_REMOVED"),
    )


def exclusion_columns(sums: DataFrame) -> DataFrame:
    kept_amount = F.col("AMOUNT_TOTAL") - F.col("AMOUNT_REMOVED")
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return sums.withColumns(
        {
            "score_after_exclusion": F.when(kept_amount > 1e-9, (F.col("GAIN_TOTAL") - F.col("GAIN_REMOVED")) / kept_amount),
            "removed_day_share": F.col("ROWS_REMOVED") / F.col("ROW_TOTAL"),
            "removed_amount_share": ratio("AMOUNT_REMOVED", "AMOUNT_TOTAL"),
            "removed_penalty_share": ratio("PENALTY_REMOVED", "PENALTY_TOTAL"),
            "kept_rows": F.col("ROW_TOTAL") - F.col("ROWS_REMOVED"),
        }
    )


_EXCLUSION = (RUN, "SHARE", "score_after_exclusion", "removed_day_share", "removed_amount_share",
              "removed_penalty_share", "kept_rows")
CURVE_SHARES = (0.0, *SHARES)


def exclusion_curve_own(frames: DataFrame, shares=CURVE_SHARES, target: float = TARGET_SCORE) -> DataFrame:
    curve = exclusion_columns(worst_day_sums(frames, shares)).select(*_EXCLUSION)
    return curve.join(minimum_removed(frames, target), RUN, "left")


def exclusion_curve_shared(frames: DataFrame, reference: str, shares=CURVE_SHARES) -> DataFrame:
    return exclusion_columns(worst_day_sums(frames, shares, reference=reference)).select(*_EXCLUSION)


def score_after_exclusion(frames: DataFrame, removed: DataFrame) -> DataFrame:
    """Scores without the given days (FORECAST_DATE): the days are joined once and summed by case."""
    marked = frames.join(removed.select(FORECAST).distinct().withColumn("_gone", F.lit(True)), FORECAST, "left")
    gone = F.col("_gone").isNotNull()
    part = lambda c: F.coalesce(F.sum(F.when(gone, c)), F.lit(0.0))
    sums = marked.groupBy(RUN).agg(
        F.count("*").alias("ROW_TOTAL"), F.sum(clipped(TARGET)).alias("AMOUNT_TOTAL"), F.sum(GAIN).alias("GAIN_TOTAL"),
        F.sum(PENALTY).alias("PENALTY_TOTAL"), F.count_if(gone).alias("ROWS_REMOVED"),
        part(clipped(TARGET)).alias("AMOUNT_REMOVED"), part(F.col(GAIN)).alias("GAIN_REMOVED"),
        part(F.col(PENALTY)).alias("PENALTY_REMOVED"),
    )
    return exclusion_columns(sums).select(*[c for c in _EXCLUSION if c != "SHARE"])


def minimum_removed(frames: DataFrame, target: float = TARGET_SCORE) -> DataFrame:
    """Fewest worst days to drop until the rest reaches the target score; nulls when it never does."""
    totals = run_totals(frames)
    zero = totals.select(RUN, F.lit(0).alias("_r"), *[F.lit(0.0).alias(c) for c in ("_cy", "_cg", "_cp")])
    steps = worst_first(frames).select(RUN, "_r", "_cy", "_cg", "_cp").unionByName(zero).join(totals, RUN)
    left = F.col("AMOUNT_TOTAL") - F.col("_cy")
    reached = F.when((left > 1e-9) & ((F.col("GAIN_TOTAL") - F.col("_cg")) / left >= target), F.col("_r"))
    pick = lambda c, t: (F.min_by(F.col(c), reached) / F.first(t))
    return steps.groupBy(RUN).agg(
        F.min(reached).alias("minimum_removed_days_to_reach_80"),
        (F.min(reached) / F.first("ROW_TOTAL")).alias("minimum_removed_day_share_to_reach_80"),
        F.when(F.min(reached).isNotNull(), pick("_cy", "AMOUNT_TOTAL")).alias("minimum_removed_amount_share_to_reach_80"),
        F.when(F.min(reached).isNotNull(), pick("_cp", "PENALTY_TOTAL")).alias("minimum_removed_penalty_share_to_reach_80"),
    )


def spike_penalty(frames: DataFrame) -> DataFrame:
    """Share of days, amount and penalty at or above the 90, 95 and 99 % amount of each run."""
    y = clipped(TARGET)
    cuts = frames.groupBy(RUN).agg(
        F.map_from_arrays(F.array(*[F.lit(f"Q{q}") for q in (90, 95, 99)]),
                          F.percentile(y, F.array(*[F.lit(q / 100) for q in (90, 95, 99)]))).alias("_m")
    ).select(RUN, F.explode("_m").alias("SPIKE_DEFINITION", "THRESHOLD"))
    inside = y >= F.col("THRESHOLD")
    share = lambda c: F.sum(F.when(inside, c).otherwise(0.0)) / F.sum(c)
    return frames.join(cuts, RUN).groupBy(RUN, "SPIKE_DEFINITION", "THRESHOLD").agg(
        F.avg(inside.cast("double")).alias("DAY_SHARE"),
        share(y).alias("ACTUAL_AMOUNT_SHARE"),
        share(F.col(PENALTY)).alias("BUSINESS_PENALTY_SHARE"),
    )


def worst_days(frames: DataFrame, n: int = 30) -> DataFrame:
    return frames.select(RUN, FORECAST, TARGET, PREDICTION, SCORE, PENALTY).orderBy(
        F.desc(F.round(PENALTY, 4)), FORECAST, RUN).limit(n)


# --- variance, entropy and spectrum --------------------------------------------------------


def residual_variance(frames: DataFrame) -> DataFrame:
    y, p = clipped(TARGET), clipped(PREDICTION)
    v = frames.groupBy(RUN).agg(F.var_pop(y).alias("VAR_ACTUAL"), F.var_pop(y - p).alias("VAR_RESIDUAL"))
    ratio = F.when(F.col("VAR_ACTUAL") != 0, F.col("VAR_RESIDUAL") / F.col("VAR_ACTUAL"))
    return v.withColumns({"RESIDUAL_VARIANCE_RATIO": ratio, "EXPLAINED_VARIANCE_STYLE_SCORE": 1.0 - ratio})


def _chi2_tail_even(q: Column, dof: int) -> Column:
    """P(X > q) for an even number of degrees of freedom: a finite Poisson sum."""
    half = q / 2
    terms = F.lit(0.0)
    for j in range(dof // 2):
        terms = terms + F.pow(half, F.lit(float(j))) / F.lit(float(math.factorial(j)))
    return F.exp(-half) * terms


def _chi2_tail_odd(q: Column, dof: int) -> Column:
    """Odd degrees of freedom: normal tail plus a finite sum (Abramowitz and Stegun 26.4.4)."""
    root = F.sqrt(q)
    density = F.exp(-q / 2) / math.sqrt(2 * math.pi)
    terms, double_factorial = F.lit(0.0), 1.0
    for j in range(1, (dof - 1) // 2 + 1):
        double_factorial *= 2 * j - 1
        terms = terms + F.pow(root, F.lit(float(2 * j - 1))) / F.lit(double_factorial)
    # Complementary error function by the rational form 7.1.26 of the same tables.
    x = root / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x) + 2 * density * terms


def autocorrelations(series: DataFrame, value: str, lags, order: str = FORECAST, keys=(RUN,)) -> DataFrame:
    """Pearson correlation of the series with itself lag rows earlier, per key."""
    by = Window.partitionBy(*keys).orderBy(order)
    lagged = series.withColumns({f"_l{k}": F.lag(value, k).over(by) for k in lags})
    return lagged.groupBy(*keys).agg(*[F.corr(value, f"_l{k}").alias(f"lag_{k}") for k in lags])


def residual_diagnostics(frames: DataFrame, ljung_box=(7, 14, 28)) -> DataFrame:
    """Mean, median, lag correlations and Ljung-Box p-values of the residuals, long form."""
    residual = frames.select(RUN, FORECAST, (clipped(PREDICTION) - clipped(TARGET)).alias("R"))
    moments = residual.groupBy(RUN).agg(F.avg("R").alias("mean residual"), F.percentile("R", 0.5).alias("median residual"))
    pearson = autocorrelations(residual, "R", (1, 7)).toDF(RUN, "lag1 residual autocorrelation", "lag7 residual autocorrelation")
    tests = ljung_box_test(residual, "R", ljung_box)
    named = tests.select(
        RUN, F.concat(F.lit("Ljung-Box p-value lag "), F.col("LAGS").cast("string")).alias("TEST"),
        F.col("P_VALUE").alias("VALUE"),
    )
    wide = moments.join(pearson, RUN)
    names = [c for c in wide.columns if c != RUN]
    return wide.unpivot([RUN], [F.col(f"`{n}`") for n in names], "TEST", "VALUE").unionByName(named)


def ljung_box_test(series: DataFrame, value: str, lags=(7, 14, 28), order: str = FORECAST, keys=(RUN,)) -> DataFrame:
    """Box statistic and p-value per key and number of lags.

    Every row meets its earlier rows of each lag by an equi-join on the row number; the lag
    products are then summed per (key, lag), so the plan does not grow with the lags.
    """
    keys = list(keys)
    mean = F.avg(value).over(Window.partitionBy(*keys))
    numbered = series.select(
        *keys, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("_i"),
        (F.col(value) - mean).alias("_x"),
    )
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col("_x") * F.col("_x")).alias("_v"))
    later = numbered.select(*keys, "_x", "_i", F.explode(F.sequence(F.lit(1), F.lit(max(lags)))).alias("_k"))
    later = later.select(*keys, "_k", (F.col("_i") - F.col("_k")).alias("_i"), F.col("_x").alias("_y"))
    products = later.join(numbered, [*keys, "_i"]).groupBy(*keys, "_k").agg(F.sum(F.col("_x") * F.col("_y")).alias("_s"))
    r = F.col("_s") / F.col("_v")
    terms = products.join(sizes, keys).select(*keys, "_n", "_k", (r * r / (F.col("_n") - F.col("_k"))).alias("_q"))
    points = terms.withColumn("LAGS", F.explode(F.array(*[F.lit(h) for h in lags]))).filter(F.col("_k") <= F.col("LAGS"))
    stat = points.groupBy(*keys, "LAGS").agg((F.first("_n") * (F.first("_n") + 2) * F.sum("_q")).alias("STATISTIC"), F.first("_n").alias("_n"))
    tail = None
    for h in lags:
        p = _chi2_tail_even(F.col("STATISTIC"), h) if h % 2 == 0 else _chi2_tail_odd(F.col("STATISTIC"), h)
        tail = F.when(F.col("LAGS") == h, p) if tail is None else tail.when(F.col("LAGS") == h, p)
    return stat.filter("_n > 30").select(*keys, "LAGS", "STATISTIC", tail.alias("P_VALUE"))


def _fourier(rows: DataFrame, sign: int = -1) -> DataFrame:
    """Discrete Fourier transform of every series s: (s, n, a, t, re, im) to (s, n, a, k, re, im), n = a x b.

    Two grouped stages of n x a and n x b rows: sums over t1 with t = b t1 + t2, then over t2 with
    k = k1 + a k2. Missing t are zeros. Phases are reduced in whole numbers, which keeps the angles exact.
    """
    b = F.expr("n div a")

    def turned(df: DataFrame, part, keys) -> DataFrame:
        angle = sign * 2 * math.pi * part
        return df.withColumn("_w", angle).groupBy("s", "n", "a", *keys).agg(
            F.sum(F.col("re") * F.cos("_w") - F.col("im") * F.sin("_w")).alias("re"),
            F.sum(F.col("re") * F.sin("_w") + F.col("im") * F.cos("_w")).alias("im"))

    first = rows.withColumns({"t1": F.expr("t div (n div a)"), "t2": F.pmod("t", b)}).withColumn("k1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)))
    inner = turned(first, F.pmod(F.col("t1") * F.col("k1"), F.col("a")) / F.col("a"), ("t2", "k1"))
    second = inner.withColumn("k2", F.explode(F.sequence(F.lit(0).cast("long"), b - 1))).withColumn("k", F.col("k1") + F.col("a") * F.col("k2"))
    return turned(second, F.pmod(F.col("t2") * F.col("k"), F.col("n")) / F.col("n"), ("k",))


def _chirped(rows: DataFrame) -> DataFrame:
    """The transform of lengths without a good divisor, but for a turn of each k: a convolution with a chirp.

    exp(-2 pi i t k / n) splits into chirps of t, k and k - t; the convolution is taken by transforms of
    a square length of at least 2 n - 1.
    """
    root = F.ceil(F.sqrt(2 * F.col("n") - 1)).cast("long")
    chirp = math.pi * F.pmod(F.col("t") * F.col("t"), 2 * F.col("n")) / F.col("n")
    square = {"_n": F.col("n"), "a": root, "n": root * root}
    down = rows.withColumns({"_c": chirp, "_x": F.col("re"), "_y": F.col("im")}).withColumns(
        {"re": F.col("_x") * F.cos("_c") + F.col("_y") * F.sin("_c"), "im": F.col("_y") * F.cos("_c") - F.col("_x") * F.sin("_c")})
    lengths = rows.groupBy("s", "n").agg(F.lit(0).alias("_0"))
    wave = lengths.withColumn("t", F.explode(F.sequence(1 - F.col("n"), F.col("n") - 1))).withColumn("_c", chirp)
    wave = wave.select("s", "n", "t", F.cos("_c").alias("re"), F.sin("_c").alias("im")).withColumns(square).withColumn("t", F.pmod("t", "n"))
    left = _fourier(down.withColumns(square).select("s", "n", "a", "t", "re", "im")).alias("x")
    right = _fourier(wave.select("s", "n", "a", "t", "re", "im")).alias("y")
    met = left.join(right, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.k") == F.col("y.k")))
    product = met.select("x.s", "x.n", "x.a", F.col("x.k").alias("t"), (F.col("x.re") * F.col("y.re") - F.col("x.im") * F.col("y.im")).alias("re"),
                         (F.col("x.re") * F.col("y.im") + F.col("x.im") * F.col("y.re")).alias("im"))
    back = _fourier(product, 1)
    return back.select("s", "k", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


#: Lengths whose two factors add up to more than this many square roots are transformed by the chirp.
UNEVEN = 16


def power_spectrum(series: DataFrame, value: str = TARGET, order: str = FORECAST, keys=()) -> DataFrame:
    """(s, k, p): power at the frequencies 1 to n / 2 of each centred series; s holds the keys, missing values are 0.

    n (a + b) rows for n = a x b with a the largest divisor up to the root; about 17 n root(n) for other lengths.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    x = series.select(key.alias("s"), order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"))
    # A series is one row per day, which the calendar bounds.
    numbered = x.withColumn("t", (F.row_number().over(Window.partitionBy("s").orderBy(order)) - 1).cast("long"))
    stats = x.groupBy(F.col("s").alias("_s")).agg(F.avg("_x").alias("m"), F.count("*").alias("n"))
    divisor = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n"))), lambda i: F.col("n") % i == 0))
    rows = numbered.join(stats.withColumn("a", divisor), F.col("s").eqNullSafe(F.col("_s"))).select(
        "s", "n", "a", "t", (F.col("_x") - F.col("m")).alias("re"), F.lit(0.0).alias("im"))
    uneven = F.col("a") + F.col("n") / F.col("a") > UNEVEN * F.sqrt("n")
    found = _fourier(rows.filter(~uneven)).select("s", "k", "re", "im").unionByName(_chirped(rows.filter(uneven)))
    half = stats.select("_s", F.floor(F.col("n") / 2).alias("_h"))
    kept = found.join(half, F.col("s").eqNullSafe(F.col("_s"))).filter("k BETWEEN 1 AND _h")
    return kept.select("s", "k", (F.col("re") ** 2 + F.col("im") ** 2).alias("p"))


def spectral_entropy(series: DataFrame, value: str = TARGET, order: str = FORECAST, keys=()) -> DataFrame:
    """Normalized entropy of the power spectrum of a daily series, or of one series per key; null without power or with one frequency."""
    power = power_spectrum(series, value, order, keys)
    total = power.groupBy(F.col("s").alias("_s")).agg(F.sum("p").alias("t"))
    share = F.try_divide("p", "t")
    entropy = power.join(total, F.col("s").eqNullSafe(F.col("_s"))).groupBy("s").agg(
        F.try_divide(-F.sum(share * F.log(share + 1e-12)), F.log(F.count("*"))).alias("SPECTRAL_ENTROPY"))
    return entropy.select(*[F.col("s")[k].alias(k) for k in keys], "SPECTRAL_ENTROPY", (1.0 - F.col("SPECTRAL_ENTROPY")).alias("FORECASTABILITY_OMEGA"))


def state_signature() -> Column:
    active = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, "True").otherwise("False")
    return F.concat(F.coalesce(F.col("DAY_OF_WEEK").cast("string"), F.lit("missing")),
                    F.lit("|lag7="), active("TARGET_LAG_7"), F.lit("|lag28="), active("TARGET_LAG_28"))


def task_labels(features: DataFrame) -> DataFrame:
    """Three classification views of the amount with the state signature, long form."""
    y = features.select(FORECAST, state_signature().alias("STATE"), clipped(TARGET).alias("Y"))
    cuts = y.agg(F.percentile("Y", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("q")).scalar()
    y = y.withColumn("_q", cuts)
    q = lambda i: F.col("_q")[i]
    bucket = ladder([(F.col("Y") <= 0, "zero"), (F.col("Y") <= q(0), "small"), (F.col("Y") <= q(1), "medium"),
                     (F.col("Y") <= q(2), "large")], "spike")
    wide = y.select(FORECAST, "STATE", ladder([(F.col("Y") > 0, "active")], "zero").alias("occurrence"),
                    ladder([(F.col("Y") >= q(2), "spike")], "normal").alias("spike_q90"), bucket.alias("amount_bucket"))
    return wide.unpivot([FORECAST, "STATE"], ["occurrence", "spike_q90", "amount_bucket"], "TASK", "LABEL")


def entropy_bits(df: DataFrame, label: str, keys=()) -> DataFrame:
    """Shannon entropy in bits of a label per key: counts, then one more grouped sum."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("h"), F.count("*").alias("CLASSES"))
    return totals.select(*keys, "CLASSES", F.col("t").alias("ROWS"), (F.log2("t") - F.col("h") / F.col("t")).alias("H_BITS"))


def conditional_entropy_bits(df: DataFrame, label: str, state: str, keys=()) -> DataFrame:
    inner = entropy_bits(df, label, [*keys, state])
    return inner.groupBy(*keys).agg((F.sum(F.col("ROWS") * F.col("H_BITS")) / F.sum("ROWS")).alias("H_GIVEN_BITS"))


def fano_bound(entropy: DataFrame, h: str = "H_GIVEN_BITS", k: str = "CLASSES", steps: int = 10_000) -> DataFrame:
    """Smallest error rate that Fano's inequality allows, on a grid made inside each row."""
    top = 1.0 - 1.0 / F.col(k)

    def rhs(i):
        p = top * i / steps
        inside = (p > 0) & (p < 1)
        binary = F.when(inside, -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)
        return binary + p * F.log2(F.greatest(F.col(k) - 1, F.lit(1)))

    grid = F.sequence(F.lit(0), F.lit(steps))
    first = F.element_at(F.filter(grid, lambda i: rhs(i) >= F.col(h)), 1)
    bound = F.when((F.col(k) <= 1) | (F.col(h) <= 0), 0.0).otherwise(F.coalesce(top * first / steps, top))
    return entropy.withColumn("FANO_ERROR_LOWER_BOUND", bound)


def entropy_fano(features: DataFrame) -> DataFrame:
    labels = task_labels(features)
    own = entropy_bits(labels, "LABEL", ["TASK"]).select("TASK", "CLASSES", F.col("H_BITS").alias("H_Y_BITS"))
    given = conditional_entropy_bits(labels, "LABEL", "STATE", ["TASK"])
    both = fano_bound(own.join(given, "TASK"))
    return both.select(
        "TASK", "CLASSES", "H_Y_BITS", F.col("H_GIVEN_BITS").alias("H_Y_GIVEN_AVAILABLE_STATE_BITS"),
        (F.col("H_Y_BITS") - F.col("H_GIVEN_BITS")).alias("MUTUAL_INFORMATION_BITS"),
        "FANO_ERROR_LOWER_BOUND", (1.0 - F.col("FANO_ERROR_LOWER_BOUND")).alias("FANO_ACCURACY_UPPER_BOUND"),
    )


# --- analog ceiling and bootstrap ----------------------------------------------------------


def analog_optimizer(features: DataFrame, names, actions, k: int = 60, min_history: int = 180, recent: int = 28) -> DataFrame:
    """Best action against the targets of the k nearest earlier days.

    Candidate actions are zero, the row's own feature values, quantiles of the earlier targets and
    the last targets; each is scored against the analogs in one grouped aggregate.
    """
    y = features.withColumn("_y", clipped(TARGET))
    near = nearest_earlier(y, CUTOFF, names, k, min_history).select(CUTOFF, "NEIGHBOUR")
    analogs = near.join(y.select(F.col(CUTOFF).alias("NEIGHBOUR"), F.col("_y").alias("_ay")), "NEIGHBOUR")
    before = Window.orderBy(CUTOFF).rowsBetween(Window.unboundedPreceding, -1)
    last = Window.orderBy(CUTOFF).rowsBetween(-recent, -1)
    quantiles = F.percentile("_y", F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)])).over(before)
    own = F.array(*[clipped(a) for a in actions])
    rows = y.select(
        CUTOFF, FORECAST, TARGET, (F.row_number().over(Window.orderBy(CUTOFF)) - 1).alias("_h"), own.alias("_own"),
        F.array_distinct(F.concat(F.array(F.lit(0.0)), own, quantiles, F.collect_list("_y").over(last))).alias("_actions"),
    )
    tried = rows.filter(F.col("_h") >= min_history).select(CUTOFF, F.explode("_actions").alias("_a"))
    pairs = tried.join(analogs.groupBy(CUTOFF).agg(F.collect_list("_ay").alias("_ys"), F.var_pop("_ay").alias("_var")), CUTOFF)
    # At most k analog targets per row, so they travel as one array.
    a = F.col("_a")
    gain = F.aggregate("_ys", F.lit(0.0), lambda s, v: s + F.when(v > 0, 100.0 * F.least(v, a) / F.greatest(v, a) * v).otherwise(0.0))
    total = F.aggregate("_ys", F.lit(0.0), lambda s, v: s + v)
    quiet = F.when(a <= 0, 100.0).otherwise(0.0)
    utility = F.when(total > 0, gain / total).otherwise(quiet)
    best = pairs.select(CUTOFF, "_a", "_var", F.size("_ys").alias("_n"), utility.alias("_u")).groupBy(CUTOFF).agg(
        F.max_by("_a", F.struct("_u", -F.col("_a"))).alias("_best"), F.max("_u").alias("EXPECTED_ANALOG_SCORE"),
        F.first("_n").alias("_n"), F.first("_var").alias("ANALOG_TARGET_VARIANCE"),
    )
    middle = F.array_sort("_own")
    size = F.size(middle)
    median = (F.get(middle, F.floor((size - 1) / 2).cast("int")) + F.get(middle, F.floor(size / 2).cast("int"))) / 2
    return rows.join(best, CUTOFF, "left").select(
        CUTOFF, FORECAST, TARGET, F.coalesce("_best", median, F.lit(0.0)).alias(PREDICTION),
        F.coalesce("_n", "_h").alias("ANALOG_COUNT"), "EXPECTED_ANALOG_SCORE", "ANALOG_TARGET_VARIANCE",
    )


def conditional_variance(analog: DataFrame) -> DataFrame:
    v = analog.agg(F.var_pop(clipped(TARGET)).alias("VAR_ACTUAL"), F.avg("ANALOG_TARGET_VARIANCE").alias("ESTIMATED_E_VAR_Y_GIVEN_X"))
    ratio = F.col("ESTIMATED_E_VAR_Y_GIVEN_X") / F.col("VAR_ACTUAL")
    return v.withColumns({"ESTIMATED_IRREDUCIBLE_VARIANCE_RATIO": ratio, "ESTIMATED_MAX_VARIANCE_EXPLAINED": 1.0 - ratio})


def block_bootstrap(frame: DataFrame, block: int = 28, replicates: int = 300, seed: int = 0) -> DataFrame:
    """Score of each replicate, made of day blocks drawn by hash until the length is reached.

    Block sums are computed once; only the last slot of a replicate may use part of a block, so
    running sums inside blocks are kept for that case.
    """
    numbered = frame.select(
        (F.row_number().over(Window.orderBy(FORECAST)) - 1).alias("_i"), clipped(TARGET).alias("_y"),
        (daily_score(TARGET, PREDICTION) * clipped(TARGET)).alias("_g"),
    ).withColumns({"_b": F.floor(F.col("_i") / block), "_o": F.col("_i") % block})
    inside = Window.partitionBy("_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    prefix = numbered.select("_b", (F.col("_o") + 1).alias("_len"), F.sum("_y").over(inside).alias("_sy"), F.sum("_g").over(inside).alias("_sg"))
    full = prefix.groupBy("_b").agg(F.max("_len").alias("_full"))
    sizes = full.agg(F.count("*").alias("blocks"), F.sum("_full").alias("n"))
    # Every block but the last is full, so blocks + blocks slots always suffice.
    slots = frame.sparkSession.range(replicates).select(F.col("id").alias("REPLICATE"))
    slots = attach(slots, sizes).withColumn("_slot", F.explode(F.sequence(F.lit(1), (2 * F.col("blocks")).cast("int"))))
    slots = slots.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "REPLICATE", "_slot"), F.col("blocks")))
    drawn = slots.join(full, "_b")
    before = Window.partitionBy("REPLICATE").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("_start", F.coalesce(F.sum("_full").over(before), F.lit(0))).filter(F.col("_start") < F.col("n"))
    drawn = drawn.withColumn("_len", F.least(F.col("_full"), F.col("n") - F.col("_start")))
    return drawn.join(prefix, ["_b", "_len"]).groupBy("REPLICATE").agg(
        F.when(F.sum("_sy") > 0, F.sum("_sg") / F.sum("_sy")).alias("BOOTSTRAP_SCORE"))


def bootstrap_interval(replicates: DataFrame) -> DataFrame:
    p = lambda q: F.percentile("BOOTSTRAP_SCORE", q)
    return replicates.agg(p(0.025).alias("LOWER_95"), p(0.5).alias("MEDIAN"), p(0.975).alias("UPPER_95"))


def score_ladder(simple: DataFrame, models: DataFrame, target: float = TARGET_SCORE) -> DataFrame:
    """Best simple and model scores, their hindsight selections and the target, with the gap to it."""
    def best(frames, label):
        s = score_summary(frames).agg(F.max("WEIGHTED_BUSINESS_SCORE").alias("SCORE"))
        return s.select(F.lit(label).alias("EVIDENCE"), "SCORE")

    def chosen(frames, label):
        s = hindsight_oracle(frames).agg(weighted_score(TARGET, PREDICTION).alias("SCORE"))
        return s.select(F.lit(label).alias("EVIDENCE"), "SCORE")

    goal = simple.sparkSession.range(1).select(F.lit("target").alias("EVIDENCE"), F.lit(target).alias("SCORE"))
    parts = [best(simple, "best simple candidate"), chosen(simple, "simple hindsight oracle"),
             best(models, "best model"), chosen(models, "model hindsight oracle"), goal]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("GAP_TO_TARGET", F.col("SCORE") - target)
