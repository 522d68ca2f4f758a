"""Ordered rules that turn numbers or names into labels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _col, any_of

# Timing buckets of TRADE_DATE - VALUE_DATE, in order.
LAG_BUCKETS = (
    "5+ days before value",
    "4 days before value",
    "3 days before value",
    "2 days before value",
    "1 day before value",
    "same day",
    "1 day after value",
    "2 days after value",
    "3 days after value",
    "4 days after value",
    "5+ days after value",
)

# Half-open bins of the absolute amount.
AMOUNT_BINS = ((0.0, 20_000.0, "low"), (20_000.0, 100_000.0, "medium"),
               (100_000.0, 1_000_000.0, "high"), (1_000_000.0, None, "huge"))


def ladder(rules, default=None) -> Column:
    """First true condition wins."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if default is None else out.otherwise(
        default if isinstance(default, Column) else F.lit(default)
    )


def lag_bucket_index(days: Column | str) -> Column:
    """0..10 for the buckets, null when the delay is unknown."""
    d = _col(days)
    # least() and greatest() skip nulls, so the null case is named.
    return F.when(d.isNotNull(), (F.least(F.greatest(d, F.lit(-5)), F.lit(5)) + 5).cast("int"))


def lag_bucket(days: Column | str) -> Column:
    names = F.array(*[F.lit(b) for b in LAG_BUCKETS])
    return F.coalesce(F.get(names, lag_bucket_index(days)), F.lit("missing"))


def bin_label(value: Column | str, bins, unknown: str | None = None) -> Column:
    """Label of half-open bins (low, high, label); high None means open."""
    x = _col(value)
    rules = []
    for low, high, label in bins:
        inside = x >= low
        if high is not None:
            inside = inside & (x < high)
        rules.append((inside, label))
    return ladder(rules, unknown)


def amount_bin(value: Column | str) -> Column:
    return bin_label(value, AMOUNT_BINS, "unknown")


def sbc_label(adi: Column | str, cv2: Column | str) -> Column:
    """Demand pattern of Syntetos, Boylan and Croston."""
    a, v = _col(adi), _col(cv2)
    often, even = a < 1.32, v < 0.49
    return ladder(
        [
            (a.isNull() | v.isNull(), "unknown"),
            (often & even, "smooth"),
            (often, "erratic"),
            (even, "intermittent"),
        ],
        "lumpy",
    )


def intermittency_class(active_ratio: Column | str) -> Column:
    r = _col(active_ratio)
    return ladder(
        [(r == 0, "no_activity"), (r < 0.02, "very_sparse"), (r < 0.20, "intermittent")], "regular"
    )


# Tokens that tell the family of a run from its name, first match wins.
RUN_FAMILIES = (
    ("quantile", ("quantile", "80_upper", "80_lower", "95_upper", "95_lower", "q80", "q95")),
    ("known_d1", ("known_amount",)),
    ("baseline", ("naive", "moving_average")),
    ("classical_or_intermittent", ("arima", "sarima", "tbats", "theta", "croston", "imapa")),
    ("zero_spike_aware", ("zero_aware", "cascade", "spike")),
    ("ensemble", ("stack", "ensemble")),
    ("tabular_ml", ("lightgbm", "xgboost", "lgb", "xgb")),
)


def infer_run_family(run_name: Column | str) -> Column:
    name = F.lower(_col(run_name))
    return ladder(
        [(any_of(name.contains(t) for t in tokens), family) for family, tokens in RUN_FAMILIES],
        "other",
    )


def quantile_role(run_name: Column | str) -> Column:
    """Struct(coverage, side) of an interval run, null for other runs."""
    name = F.translate(F.lower(_col(run_name)), "-/", "__")
    coverage = F.regexp_extract(name, "(80|95)", 1)
    side = ladder([(name.contains("lower"), "lower"), (name.contains("upper"), "upper")])
    return F.when(
        (coverage != "") & side.isNotNull(), F.struct(coverage.alias("coverage"), side.alias("side"))
    )


def safe_divide(numerator: Column | str, denominator: Column | str, scalar: bool = False) -> Column:
    """Null on a zero denominator; the scalar form answers 0.0 instead."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d != 0, n / d).otherwise(F.lit(0.0) if scalar else F.lit(None).cast("double"))
