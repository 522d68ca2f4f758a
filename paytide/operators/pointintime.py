"""Feature rows and labels that use only what was known at a cutoff.

A movement of day VALUE_DATE booked on TRADE_DATE is known at cutoff c exactly when its *delay*
(TRADE_DATE - VALUE_DATE) is at most the *age* c - VALUE_DATE. Running sums over the delay give,
per landing day, a few steps "from this age on the day looked like that". Every point-in-time
need is then an equi-join or one grouped aggregate on those steps; no cutoff is ever compared
with all earlier bookings, and no row is built for a day on which nothing was booked.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import CALENDAR_FEATURES, calendar_attributes
from .gold import (
    KNOWN,
    KNOWN_COUNT,
    TARGET,
    TRADE,
    VALUE,
    bounds_columns,
    date_bounds,
    sum_or_zero,
)

CUTOFF, FORECAST = "CUTOFF_DATE", "FORECAST_DATE"
HORIZON = 1

# Aggregations of a rolling window and the stems of their column names.
WINDOW_STEMS = {
    "mean": "TARGET_ROLLING_MEAN",
    "std": "TARGET_STD",
    "non_zero_ratio": "TARGET_NON_ZERO_RATIO",
}


@dataclass(frozen=True)
class FeatureSpec:
    kind: str = "tabular"
    lags: tuple[int, ...] = (1, 7, 14, 28)
    windows: dict[int, tuple[str, ...]] = field(
        default_factory=lambda: {7: ("mean",), 28: ("mean", "std", "non_zero_ratio")}
    )
    history: int = 90
    calendar: bool = True
    known_d1: bool = True
    cross: bool = True

    def __post_init__(self):
        if self.kind not in ("tabular", "time_series"):
            raise ValueError(f"unknown dataset kind: {self.kind}")
        for days, aggs in self.windows.items():
            unknown = [a for a in aggs if a not in WINDOW_STEMS]
            if days < 1 or not aggs or unknown:
                raise ValueError(f"bad rolling window {days}: {aggs}")

    @property
    def oldest_age(self) -> int:
        spans = [min(w, self.history) for w in self.windows] + list(self.lags) + [0]
        return max(spans) - 1

    def lag_names(self) -> list[str]:
        return [f"TARGET_LAG_{k}" for k in self.lags]

    def window_names(self) -> list[str]:
        return [f"{WINDOW_STEMS[a]}_{w}" for w, aggs in self.windows.items() for a in aggs]


@dataclass(frozen=True)
class Rescale:
    """A change of units applied to day totals, and what it makes of an empty day."""

    apply: Callable[[Column], Column] = lambda x: x
    empty_day: Column | None = None

    @property
    def zero(self) -> Column:
        return F.lit(0.0) if self.empty_day is None else self.empty_day


def as_of_steps(known: DataFrame, seq=()) -> DataFrame:
    """Per landing day: amount and count as seen from age FROM_AGE up to before NEXT_AGE.

    Bookings are first summed per delay; the window then runs over the distinct delays of one
    day, never over movements.
    """
    delay = F.greatest(F.datediff(TRADE, VALUE), F.lit(-HORIZON))
    per_delay = (
        known.filter(F.col(VALUE).isNotNull() & F.col(TRADE).isNotNull())
        .groupBy(*seq, VALUE, delay.alias("FROM_AGE"))
        .agg(F.sum(KNOWN).alias("_a"), F.sum(KNOWN_COUNT).alias("_n"))
    )
    by_delay = Window.partitionBy(*seq, VALUE).orderBy("FROM_AGE")
    running = by_delay.rowsBetween(Window.unboundedPreceding, 0)
    return per_delay.select(
        *seq,
        VALUE,
        "FROM_AGE",
        F.lead("FROM_AGE").over(by_delay).alias("NEXT_AGE"),
        F.sum("_a").over(running).alias("AMOUNT"),
        F.sum("_n").over(running).alias("COUNT"),
    )


def as_of_rows(steps: DataFrame, oldest_age: int, cutoffs: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per (landing day, age up to oldest_age) with the amount known at that age."""
    last = F.least(F.coalesce(F.col("NEXT_AGE") - 1, F.lit(oldest_age)), F.lit(oldest_age))
    rows = steps.filter(F.col("FROM_AGE") <= oldest_age)
    if cutoffs is not None:
        rows = rows.filter(
            F.col(VALUE).between(F.date_sub(cutoffs[0], oldest_age), F.date_add(cutoffs[1], HORIZON))
        )
    rows = rows.withColumn("AGE", F.explode(F.sequence("FROM_AGE", last)))
    rows = rows.withColumn(CUTOFF, F.date_add(VALUE, F.col("AGE"))).drop("FROM_AGE", "NEXT_AGE")
    if cutoffs is not None:
        rows = rows.filter(F.col(CUTOFF).between(*cutoffs))
    return rows


def day_range(start, end) -> tuple[Column, Column]:
    as_day = lambda v: v if isinstance(v, Column) else F.lit(str(v)).cast("date")
    return as_day(start), as_day(end)


def gold_calendar_bounds(realized: DataFrame, known: DataFrame) -> tuple[Column, Column]:
    return bounds_columns(date_bounds((realized, VALUE), (known, VALUE), (known, TRADE)))


def cutoff_grid(source: DataFrame, start, end, calendar: tuple[Column, Column], seq=()) -> DataFrame:
    """Cutoffs whose forecast date lies inside the calendar, per sequence."""
    lo, hi = day_range(start, end)
    base = source.select(*seq).distinct() if seq else source.sparkSession.range(1).select()
    grid = base.select(*seq, F.explode(F.sequence(lo, hi)).alias(CUTOFF))
    grid = grid.withColumn(FORECAST, F.date_add(CUTOFF, HORIZON))
    return grid.filter(F.col(FORECAST).between(*calendar))


def _feature_aggregates(spec: FeatureSpec, scale: Rescale) -> list[Column]:
    """Sums over as-of rows of one cutoff, from which every feature follows."""
    age, amount = F.col("AGE"), scale.apply(F.col("AMOUNT"))
    at = lambda a, x: F.max(F.when(age == a, x))
    out = [at(k - 1, amount).alias(f"_lag_{k}") for k in spec.lags]
    out += [at(-HORIZON, amount).alias("_d1"), at(-HORIZON, F.col("COUNT")).alias("_d1n")]
    for w in spec.windows:
        inside = (age >= 0) & (age < min(w, spec.history))
        value = F.when(inside, amount)
        out += [
            F.count(value).alias(f"_n_{w}"),
            F.sum(value).alias(f"_s_{w}"),
            F.sum(value * value).alias(f"_q_{w}"),
            F.count_if(inside & (amount != 0)).alias(f"_z_{w}"),
        ]
    return out


def point_in_time_features(
    grid: DataFrame,
    rows: DataFrame,
    spec: FeatureSpec,
    calendar: tuple[Column, Column],
    keys=(),
    scale: Rescale = Rescale(),
) -> DataFrame:
    """Grid rows with lags, rolling statistics, D+1 known amounts and calendar attributes."""
    sums = rows.groupBy(*keys, CUTOFF).agg(*_feature_aggregates(spec, scale))
    wide = grid.join(sums, [*keys, CUTOFF], "left").withColumn("_first_day", calendar[0])
    zero = scale.zero
    first_day = F.col("_first_day")
    columns: dict[str, Column] = {}
    for k in spec.lags:
        in_calendar = F.date_sub(FORECAST, k) >= first_day
        empty = F.when(in_calendar, zero).otherwise(0.0)
        columns[f"TARGET_LAG_{k}"] = F.coalesce(f"_lag_{k}", empty)
    for w, aggs in spec.windows.items():
        days = F.least(F.lit(min(w, spec.history)), F.datediff(CUTOFF, first_day) + 1)
        empty_days = days - F.coalesce(f"_n_{w}", F.lit(0))
        total = F.coalesce(f"_s_{w}", F.lit(0.0)) + empty_days * zero
        squares = F.coalesce(f"_q_{w}", F.lit(0.0)) + empty_days * zero * zero
        non_zero = F.coalesce(f"_z_{w}", F.lit(0)) + F.when(zero != 0, empty_days).otherwise(0)
        mean = total / days
        forms = {
            "mean": mean,
            "std": F.sqrt(F.greatest(squares / days - mean * mean, F.lit(0.0))),
            "non_zero_ratio": non_zero / days,
        }
        for a in aggs:
            columns[f"{WINDOW_STEMS[a]}_{w}"] = F.when(days > 0, forms[a]).otherwise(0.0)
    out = wide.withColumns(columns)
    id_columns = [*keys, CUTOFF, FORECAST]
    if spec.kind == "time_series":
        return out.select(*id_columns, *columns)
    selected = [F.col(c) for c in columns]
    if spec.known_d1:
        selected += [
            F.coalesce("_d1", zero).alias("KNOWN_AMOUNT_D1"),
            F.coalesce("_d1n", F.lit(0)).alias("KNOWN_COUNT_D1"),
        ]
    if spec.cross:
        selected += [
            F.lit(0.0).alias("CROSS_MOVEMENT_KNOWN_AMOUNT_D1"),
            F.lit(0).cast("bigint").alias("CROSS_MOVEMENT_KNOWN_COUNT_D1"),
        ]
    attributes = calendar_attributes(FORECAST) if spec.calendar else []
    return out.select(*id_columns, *attributes, *selected)


def cross_movement_known(features: DataFrame, group=("ENTITY_SHORTNAME", "CURRENCY_SHORTNAME")) -> DataFrame:
    """D+1 known totals of the other scopes of the same group, for grain-mode features."""
    own = features.groupBy(*group, CUTOFF).agg(
        F.sum("KNOWN_AMOUNT_D1").alias("_all_a"), F.sum("KNOWN_COUNT_D1").alias("_all_n")
    )
    return (
        features.join(own, [*group, CUTOFF])
        .withColumns(
            {
                "CROSS_MOVEMENT_KNOWN_AMOUNT_D1": F.col("_all_a") - F.col("KNOWN_AMOUNT_D1"),
                "CROSS_MOVEMENT_KNOWN_COUNT_D1": F.col("_all_n") - F.col("KNOWN_COUNT_D1"),
            }
        )
        .drop("_all_a", "_all_n")
    )


# --- labels --------------------------------------------------------------------------------


def final_targets(realized: DataFrame, seq=()) -> DataFrame:
    return realized.groupBy(*seq, F.col(VALUE).alias("DATE")).agg(F.sum(TARGET).alias(TARGET))


def labels_as_of(known: DataFrame, as_of, seq=()) -> DataFrame:
    """Day totals from bookings made up to one date."""
    seen = known.filter(F.col(TRADE) <= day_range(as_of, as_of)[0])
    return seen.groupBy(*seq, F.col(VALUE).alias("DATE")).agg(F.sum(KNOWN).alias(TARGET))


def available_panel(known: DataFrame, calendar: DataFrame, cutoff) -> DataFrame:
    """The whole calendar as it looked at one cutoff."""
    labels = labels_as_of(known, cutoff)
    return calendar.join(labels, "DATE", "left").withColumn(TARGET, F.coalesce(TARGET, F.lit(0.0)))


def with_labels(features: DataFrame, labels: DataFrame, seq=()) -> DataFrame:
    """Attach TARGET_AMOUNT of the forecast date, zero when nothing landed."""
    named = labels.withColumnRenamed("DATE", FORECAST)
    return features.join(named, [*seq, FORECAST], "left").withColumn(
        TARGET, F.coalesce(TARGET, F.lit(0.0))
    )


def dataset_build(
    realized: DataFrame,
    known: DataFrame,
    start,
    end,
    spec: FeatureSpec = FeatureSpec(),
    label_as_of=None,
    seq=(),
    scale: Rescale = Rescale(),
) -> DataFrame:
    """One row per cutoff: ids, target, features. Final labels unless label_as_of is given."""
    calendar = gold_calendar_bounds(realized, known)
    grid = cutoff_grid(known, start, end, calendar, seq)
    rows = as_of_rows(as_of_steps(known, seq), spec.oldest_age, day_range(start, end))
    features = point_in_time_features(grid, rows, spec, calendar, seq, scale)
    if label_as_of is None:
        labels = final_targets(realized, seq)
    else:
        labels = labels_as_of(known, label_as_of, seq)
    out = with_labels(features, labels, seq)
    rest = [c for c in features.columns if c not in (*seq, CUTOFF, FORECAST)]
    return out.select(*seq, CUTOFF, FORECAST, scale.apply(F.col(TARGET)).alias(TARGET), *rest)


# Columns that are never features.
NON_FEATURES = ("ABS_ERROR", "POINT_FORECAST", "PREDICTION", "RULESET_ID", "TRAIN_CUTOFF_END",
                "TRAIN_CUTOFF_START", "TARGET_AMOUNT")
NON_FEATURE_PREFIXES = ("PREDICTION_LOWER_", "PREDICTION_UPPER_")
_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint", "boolean")


def numeric_feature_columns(df: DataFrame) -> list[str]:
    return [
        c
        for c, t in df.dtypes
        if (t in _NUMERIC or t.startswith("decimal"))
        and c not in NON_FEATURES
        and not c.startswith(NON_FEATURE_PREFIXES)
    ]


def numeric_features(df: DataFrame, keep=()) -> DataFrame:
    """Ids plus every feature as a double, missing values as 0.0."""
    columns = [c for c in numeric_feature_columns(df) if c not in keep]
    return df.select(
        *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    )


def dataset_manifest(dataset: DataFrame, spec: FeatureSpec, ruleset_id: str, label_as_of=None) -> DataFrame:
    ids = {CUTOFF, FORECAST, TARGET}
    features = [c for c in dataset.columns if c not in ids]
    policy = "TRADE_DATE <= EVALUATION_CUTOFF" if label_as_of else "final realized VALUE_DATE totals"
    return dataset.agg(
        F.lit(spec.kind).alias("dataset_kind"),
        F.lit(ruleset_id).alias("ruleset_id"),
        F.count("*").alias("row_count"),
        F.min(CUTOFF).alias("first_cutoff"),
        F.max(CUTOFF).alias("last_cutoff"),
        F.lit(HORIZON).alias("forecast_horizon_days"),
        F.lit("TRADE_DATE <= CUTOFF_DATE").alias("feature_policy"),
        F.lit(policy).alias("training_label_policy"),
        F.lit(spec.history).alias("history_window_days"),
        F.array(*[F.lit(c) for c in features]).alias("feature_columns"),
    )


