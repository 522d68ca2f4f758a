"""Target transforms: fits are aggregates over a grid of powers, all folds at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import EVAL
from .gold import TARGET
from .pointintime import Rescale

TINY = 1e-6
#: Stands for a missing power where a null would not do.
NO_POWER = -1e300
# Coarse grid of (power, distance to the next one), growing by a quarter beyond 5 either way; then
# repeatedly twenty finer steps on each side of the best one.
_OUTER = tuple(5 * 1.25**i for i in range(1, 21))
POWER_GRID = (tuple((round(-5 + 0.25 * i, 2), 0.25) for i in range(41))
              + tuple((sign * p, 0.25 * p) for p in _OUTER for sign in (-1, 1)))
FINER = 20
REFINEMENTS = 4


def log1p(x: Column) -> Column:
    return F.when(x < -1, F.raise_error(F.lit("log1p needs amounts of at least -1"))).otherwise(F.log1p(x))


def expm1(x: Column) -> Column:
    return F.expm1(x)


def box_cox(x: Column, power: Column, shift: Column) -> Column:
    """Power form of x + shift, which must be positive; a null power leaves x unchanged."""
    moved = x + shift
    form = F.when(power == 0, F.log(moved)).otherwise((F.pow(moved, power) - 1) / power)
    checked = F.when(moved <= 0, F.raise_error(F.lit("box-cox needs positive amounts after the shift")))
    return F.when(power.isNull(), x).otherwise(checked.otherwise(form))


def box_cox_inverse(z: Column, power: Column, shift: Column) -> Column:
    form = F.when(power == 0, F.exp(z)).otherwise(F.pow(z * power + 1, 1 / power))
    return F.when(power.isNull(), z).otherwise(form - shift)


def yeo_johnson(x: Column, power: Column) -> Column:
    up = F.when(power == 0, F.log1p(x)).otherwise((F.pow(x + 1, power) - 1) / power)
    down = F.when(power == 2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - power) - 1) / (2 - power))
    return F.when(power.isNull(), x).when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(z: Column, power: Column) -> Column:
    up = F.when(power == 0, F.expm1(z)).otherwise(F.pow(z * power + 1, 1 / power) - 1)
    down = F.when(power == 2, -F.expm1(-z)).otherwise(1 - F.pow(1 - z * (2 - power), 1 / (2 - power)))
    return F.when(power.isNull(), z).when(z >= 0, up).otherwise(down)


def _log_likelihood(kind: str, power: Column) -> Column:
    """Gaussian log-likelihood of the transformed values plus the Jacobian, as an aggregate."""
    x = F.col("_x")
    if kind == "box_cox":
        moved = F.log(x)
        # Powers are taken of x / geometric mean, so that large amounts stay in range.
        z = F.when(power == 0, moved).otherwise((F.exp(power * moved) - 1) / power)
        jacobian = F.sum(moved)
    else:
        z = yeo_johnson(x, power)
        jacobian = F.sum(F.sign(x) * F.log1p(F.abs(x)))
    return -F.count("_x") / 2 * F.log(F.greatest(F.var_pop(z), F.lit(1e-300))) + (F.first("_p") - 1) * jacobian


def fit_power(rows: DataFrame, kind: str, keys=(EVAL,), target: str = TARGET, cover_zero: bool = False) -> DataFrame:
    """Maximum-likelihood POWER and SHIFT per key; a null POWER means leave the values as they are.

    ``cover_zero``: the shift of box_cox also makes 0 positive, for features of days without bookings.

    Every round evaluates all candidate powers of all keys in one grouped aggregate and narrows the
    grid around the best one, so neither folds nor candidates are looped over on the driver.
    """
    if kind not in ("box_cox", "yeo_johnson"):
        raise ValueError(f"no fitted transform: {kind}")
    keys = list(keys)
    values = rows.select(*keys, F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("_y"))
    stats = values.groupBy(*keys).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    if kind == "box_cox":
        least = F.least(F.col("_lo"), F.lit(0.0)) if cover_zero else F.col("_lo")
        shift = F.greatest(F.lit(0.0), TINY - least)
        stats = stats.withColumns({"SHIFT": shift, "_flat": F.col("_lo") == F.col("_hi")})
    else:
        stats = stats.withColumns({"SHIFT": F.lit(0.0), "_flat": F.lit(False)})
    data = values.join(stats.select(*keys, "SHIFT"), keys).select(*keys, (F.col("_y") + F.col("SHIFT")).alias("_x"))
    data = data.persist()  # every round reads it again
    start = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(float(w)).alias("w")) for p, w in POWER_GRID])
    grid = stats.select(*keys, F.explode(start).alias("_g")).select(*keys, F.col("_g.p").alias("_p"), F.col("_g.w").alias("_w"))
    for round_number in range(REFINEMENTS + 1):
        scored = data.join(grid, keys).groupBy(*keys, "_p", "_w").agg(_log_likelihood(kind, F.col("_p")).alias("_ll"))
        finite = F.when(~F.isnan("_ll") & (F.abs("_ll") < float("inf")), F.col("_ll"))  # far powers overflow
        best = scored.groupBy(*keys).agg(F.max_by(F.struct("_p", "_w"), finite).alias("_b"))
        if round_number < REFINEMENTS:
            finer = F.transform(F.sequence(F.lit(-FINER), F.lit(FINER)), lambda i: F.struct(
                (F.col("_b._p") + i * F.col("_b._w") / FINER).alias("p"), (F.col("_b._w") / FINER).alias("w")))
            grid = best.select(*keys, F.explode(finer).alias("_g")).select(*keys, F.col("_g.p").alias("_p"), F.col("_g.w").alias("_w"))
    power = F.when(F.col("_flat"), F.lit(None)).otherwise(F.round("_b._p", 10))
    return stats.join(best, keys).select(*keys, power.alias("POWER"), "SHIFT")


def rescale(kind: str, power: Column | None = None, shift: Column | None = None) -> Rescale:
    """Units for the feature builder; power and shift may be columns joined per fold."""
    zero = F.lit(0.0)
    if kind == "none":
        return Rescale()
    if kind == "log1p":
        return Rescale(log1p, log1p(zero))
    if kind == "box_cox":
        return Rescale(lambda x: box_cox(x, power, shift), box_cox(zero, power, shift))
    if kind == "yeo_johnson":
        return Rescale(lambda x: yeo_johnson(x, power), yeo_johnson(zero, power))
    raise ValueError(f"unknown target transform: {kind}")


def inverse(kind: str, z: Column, power: Column | None = None, shift: Column | None = None) -> Column:
    if kind == "none":
        return z
    if kind == "log1p":
        return expm1(z)
    if kind == "box_cox":
        return box_cox_inverse(z, power, shift)
    if kind == "yeo_johnson":
        return yeo_johnson_inverse(z, power)
    raise ValueError(f"unknown target transform: {kind}")


def fold_features_in_fitted_units(folds, kind: str) -> DataFrame:
    """Training and inference features of every fold in the units fitted on that fold's labels.

    Lags, means and known amounts follow the fold's own power, so as-of rows meet the folds that
    use their cutoff and are aggregated per (fold, cutoff).
    """
    from .backtest import TRAIN_FROM, fold_labels
    from .pointintime import CUTOFF, as_of_rows, day_range, point_in_time_features

    keys = (EVAL, *folds.seq)
    if kind in ("none", "log1p"):  # nothing to fit
        days = folds.folds.select(EVAL) if not folds.seq else folds.training(()).select(*keys).distinct()
        fit = days.withColumns({"POWER": F.lit(None).cast("double"), "SHIFT": F.lit(0.0)})
    else:
        fit = fit_power(folds.training(()), kind, keys, cover_zero=True)
    # Powers are grouping keys below, where a null would meet nothing.
    fit = fit.withColumn("POWER", F.coalesce("POWER", F.lit(NO_POWER)))
    power = F.nullif(F.col("POWER"), F.lit(NO_POWER))
    spans = folds.folds.withColumn(CUTOFF, F.explode(F.sequence(TRAIN_FROM, EVAL))).select(EVAL, CUTOFF)
    grid = folds.grid.join(spans, CUTOFF).join(fit, [EVAL, *folds.seq])
    rows = as_of_rows(folds.steps, folds.spec.oldest_age)
    rows = rows.join(spans, CUTOFF).join(fit, [EVAL, *folds.seq])
    units = rescale(kind, power, F.col("SHIFT"))
    features = point_in_time_features(
        grid, rows, folds.spec, folds.calendar, (EVAL, *folds.seq, "POWER", "SHIFT"), units
    )
    labelled = fold_labels(features, folds.steps, folds.seq)
    return labelled.withColumn(TARGET, units.apply(F.col(TARGET))).withColumn("POWER", power)


def transformed_backtest(folds, kind: str, model) -> DataFrame:
    """Rolling-origin predictions of a model that works in transformed units: features and labels of each fold in the
    units fitted on that fold's labels, the forecast inverted with the same power and shift.

    ``model(training, rows)`` returns the rows with PREDICTION; the final label stays in the original units.
    """
    from .backtest import PREDICTION
    from .pointintime import CUTOFF, with_labels

    rows = fold_features_in_fitted_units(folds, kind)
    units = ["POWER", "SHIFT"]
    training = rows.filter(F.col(CUTOFF) < F.col(EVAL)).drop(*units)
    ask = rows.filter(F.col(CUTOFF) == F.col(EVAL)).drop(TARGET)
    fit = ask.select(EVAL, *folds.seq, *units)
    predicted = model(training, ask.drop(*units)).join(fit, [EVAL, *folds.seq])
    back = predicted.withColumn(PREDICTION, inverse(kind, F.col(PREDICTION), F.col("POWER"), F.col("SHIFT")))
    return with_labels(back.drop(*units), folds.final, folds.seq)
