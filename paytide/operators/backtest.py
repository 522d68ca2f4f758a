"""Rolling-origin evaluation: all folds of a run in one job."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ladder
from .gold import TARGET, VALUE
from .pointintime import (
    CUTOFF,
    FORECAST,
    HORIZON,
    FeatureSpec,
    as_of_rows,
    as_of_steps,
    cutoff_grid,
    day_range,
    final_targets,
    gold_calendar_bounds,
    point_in_time_features,
    with_labels,
)

EVAL, TRAIN_FROM, TRAIN_TO = "EVALUATION_CUTOFF", "TRAIN_CUTOFF_START", "TRAIN_CUTOFF_END"
PREDICTION, ABS_ERROR = "PREDICTION", "ABS_ERROR"

# Column order of a prediction table.
PREDICTION_COLUMNS = (CUTOFF, FORECAST, TARGET, PREDICTION, ABS_ERROR, EVAL, TRAIN_FROM, TRAIN_TO)


def fold_grid(spark, start, end, train_window: int, step_days: int = 1) -> DataFrame:
    """One fold per evaluation day (or every few days); training cutoffs end the day before it."""
    lo, hi = day_range(start, end)
    every = F.make_dt_interval(days=F.lit(step_days))
    folds = spark.range(1).select(F.explode(F.sequence(lo, hi, every)).alias(EVAL))
    return folds.withColumns(
        {
            TRAIN_FROM: F.date_sub(EVAL, HORIZON + train_window - 1),
            TRAIN_TO: F.date_sub(EVAL, HORIZON),
        }
    )


class FoldData:
    """Features once per cutoff, labels per fold.

    A feature row depends on its cutoff only, so the features of all training cutoffs are
    computed once and joined to the folds; only the label depends on the evaluation date.
    """

    def __init__(self, realized, known, start, end, train_window, spec=FeatureSpec(), seq=(), step_days=1):
        self.seq = tuple(seq)
        self.spec = spec
        self.spark = known.sparkSession
        self.calendar = gold_calendar_bounds(realized, known)
        self.folds = fold_grid(self.spark, start, end, train_window, step_days)
        self.steps = as_of_steps(known, seq)
        lo, hi = day_range(start, end)
        first = F.date_sub(lo, HORIZON + train_window - 1)
        self.grid = cutoff_grid(known, first, hi, self.calendar, seq)
        rows = as_of_rows(self.steps, spec.oldest_age, (first, hi))
        self.features = point_in_time_features(self.grid, rows, spec, self.calendar, seq)
        self.final = final_targets(realized, seq)

    def cache(self) -> "FoldData":
        self.features = self.features.persist()
        self.steps = self.steps.persist()
        return self

    def training(self, columns=None) -> DataFrame:
        """Fold x training cutoff with the label as seen on the evaluation day."""
        return fold_labels(self.training_cutoffs(columns), self.steps, self.seq)

    def training_cutoffs(self, columns=None) -> DataFrame:
        exploded = self.folds.withColumn(CUTOFF, F.explode(F.sequence(TRAIN_FROM, TRAIN_TO)))
        features = self.features
        if columns is not None:
            features = features.select(*self.seq, CUTOFF, FORECAST, *columns)
        return features.join(exploded, CUTOFF)

    def inference(self) -> DataFrame:
        """Fold's own cutoff with the final label."""
        at = self.folds.withColumn(CUTOFF, F.col(EVAL))
        return with_labels(self.features.join(at, CUTOFF), self.final, self.seq)


def fold_labels(rows: DataFrame, steps: DataFrame, seq=()) -> DataFrame:
    """TARGET_AMOUNT of FORECAST_DATE as known on EVALUATION_CUTOFF: an equi-join on the day."""
    s = steps.select(
        *[F.col(c).alias(f"_s_{c}") for c in seq],
        F.col(VALUE).alias("_day"),
        "FROM_AGE",
        "NEXT_AGE",
        F.col("AMOUNT").alias("_label"),
    )
    age = F.datediff(EVAL, FORECAST)
    on = (
        (F.col(FORECAST) == F.col("_day"))
        & (age >= F.col("FROM_AGE"))
        & (F.col("NEXT_AGE").isNull() | (age < F.col("NEXT_AGE")))
    )
    for c in seq:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    joined = rows.join(s, on, "left").withColumn(TARGET, F.coalesce("_label", F.lit(0.0)))
    return joined.drop("_day", "FROM_AGE", "NEXT_AGE", "_label", *[f"_s_{c}" for c in seq])


def training_stats(training: DataFrame, keys=(EVAL,), last_n: int | None = None) -> DataFrame:
    """Last and mean training label per fold, optionally the mean of the last n."""
    out = [
        F.max_by(TARGET, FORECAST).alias("LAST_VALUE"),
        F.avg(TARGET).alias("MEAN_VALUE"),
        F.count("*").alias("TRAINING_ROWS"),
    ]
    if last_n is not None:
        recent = F.datediff(F.col(EVAL), F.col(FORECAST)) < last_n
        out.append(F.avg(F.when(recent, F.col(TARGET))).alias(f"MEAN_LAST_{last_n}"))
    return training.groupBy(*keys).agg(*out)


def backtest_errors(predictions: DataFrame, seq=(), extra=()) -> DataFrame:
    out = predictions.withColumn(ABS_ERROR, F.abs(F.col(PREDICTION) - F.col(TARGET)))
    return out.select(*seq, *PREDICTION_COLUMNS, *extra)


def fold_skip_reasons(folds: DataFrame, training: DataFrame, inference: DataFrame) -> DataFrame:
    """Folds per state; a fold without training or inference rows is not fitted."""
    t = training.groupBy(EVAL).agg(F.count("*").alias("_t"))
    i = inference.groupBy(EVAL).agg(F.count("*").alias("_i"))
    counted = folds.join(t, EVAL, "left").join(i, EVAL, "left")
    no_t, no_i = F.col("_t").isNull(), F.col("_i").isNull()
    state = ladder(
        [
            (no_t & no_i, "empty_training_and_inference_data"),
            (no_t, "empty_training_data"),
            (no_i, "empty_inference_data"),
        ],
        "completed",
    )
    return counted.groupBy(state.alias("fold_state")).agg(
        F.count("*").alias("folds"),
        F.coalesce(F.sum("_t"), F.lit(0)).alias("training_rows"),
        F.coalesce(F.sum("_i"), F.lit(0)).alias("inference_rows"),
    )


def backtest_run_report(folds: DataFrame, training: DataFrame, inference: DataFrame,
                        predictions: DataFrame) -> DataFrame:
    """One row of fold and row counts for a run."""
    states = fold_skip_reasons(folds, training, inference)
    done = F.col("fold_state") == "completed"
    counts = states.agg(
        F.sum("folds").alias("cutoff_count"),
        F.sum(F.when(done, F.col("folds")).otherwise(0)).alias("completed_folds"),
        F.sum(F.when(~done, F.col("folds")).otherwise(0)).alias("skipped_folds"),
        F.sum("training_rows").alias("training_row_count"),
        F.sum("inference_rows").alias("inference_row_count"),
    )
    rows = predictions.agg(F.count("*").alias("n")).select("n").scalar()
    return counts.withColumn("prediction_row_count", rows)


def rank_runs(predictions: DataFrame, run: str = "RUN_NAME") -> DataFrame:
    """Error summary per run, best first. A run has one row per day, so exact quantiles fit."""
    error = F.coalesce(F.col(ABS_ERROR), F.abs(F.col(PREDICTION) - F.col(TARGET)))
    return (
        predictions.groupBy(run)
        .agg(
            F.count("*").alias("prediction_rows"),
            F.avg(error).alias("mae"),
            F.percentile(error, 0.5).alias("median_ae"),
            F.percentile(error, 0.9).alias("p90_ae"),
        )
        .orderBy("mae", "p90_ae", "median_ae", run)
    )
