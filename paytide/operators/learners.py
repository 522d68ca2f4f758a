"""Learned forecasts: fitted per fold by one job for all folds."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import EVAL, PREDICTION
from .boosting import Head, feature_names, fit_predict
from .gold import TARGET
from .pointintime import CUTOFF, FORECAST


def gbt_regressor(training: DataFrame, inference: DataFrame, label: str = TARGET, loss: str = "squared", keys=(EVAL,), **budget) -> DataFrame:
    """Boosted trees; the mean label when there is too little to split. ``loss``: squared, pinball (the median) or tweedie."""
    return fit_predict(training, inference, {PREDICTION: Head(label, loss)}, keys, **budget)


def tweedie(training: DataFrame, inference: DataFrame, power: float = 1.5, reg: float = 0.1, keys=(EVAL,)) -> DataFrame:
    """Zero-heavy positive target: generalized linear model with a log link on scaled features."""
    return fit_predict(training, inference, {PREDICTION: Head(TARGET, "linear_tweedie", power=power, reg=reg)}, keys)


def gbt_probability(training: DataFrame, inference: DataFrame, label: str, out: str, keys=(EVAL,), **budget) -> DataFrame:
    """Probability of label 1 by boosted trees; the class rate when only one class was seen."""
    return fit_predict(training, inference, {out: Head(label, "logistic")}, keys, **budget)


def logistic_probability(training: DataFrame, inference: DataFrame, label: str, out: str, reg: float = 0.01, keys=(EVAL,)) -> DataFrame:
    """Scaled, class-balanced logistic regression."""
    return fit_predict(training, inference, {out: Head(label, "linear_logistic", reg=reg)}, keys)


#: Classifier of the two-part models, by name.
CLASSIFIERS = {"gbt": {"loss": "logistic"}, "logistic": {"loss": "linear_logistic", "reg": 0.01}}


def zero_aware(training: DataFrame, inference: DataFrame, classifier: str = "gbt", keys=(EVAL,), **budget) -> DataFrame:
    """P(amount is not zero) times the amount expected given that it is not."""
    labelled = training.withColumns({"_occurs": (F.col(TARGET) != 0).cast("double"), "_some": F.col(TARGET) != 0})
    heads = {"_p": Head("_occurs", **CLASSIFIERS[classifier]), PREDICTION: Head(TARGET, where="_some")}
    scored = fit_predict(labelled, inference, heads, keys, feature_names(inference), **budget)
    return scored.withColumn(PREDICTION, F.col("_p") * F.col(PREDICTION)).drop("_p")


# --- occurrence and spike cascade ----------------------------------------------------------


def cascade_labels(training: DataFrame, quantile: float = 0.90, keys=(EVAL,)) -> DataFrame:
    """Spike threshold, regime counts and fallback means per fold."""
    y = F.coalesce(F.col(TARGET), F.lit(0.0))
    keys = list(keys)
    cut = training.groupBy(*keys).agg(F.percentile(F.when(y > 0, y), quantile).alias("SPIKE_THRESHOLD"))
    rows = training.join(cut, keys)
    spike, normal = y > F.col("SPIKE_THRESHOLD"), (y > 0) & (y <= F.col("SPIKE_THRESHOLD"))
    out = rows.groupBy(*keys, "SPIKE_THRESHOLD").agg(
        F.count_if(y > 0).alias("OCCURRENCES"), F.count_if(spike).alias("SPIKES"), F.count_if(normal).alias("NORMALS"),
        F.coalesce(F.avg(F.when(normal, y)), F.lit(0.0)).alias("NORMAL_FALLBACK"),
        F.coalesce(F.avg(F.when(spike, y)), F.lit(0.0)).alias("SPIKE_FALLBACK"))
    fallback = F.when(F.col("SPIKE_FALLBACK") == 0, F.col("NORMAL_FALLBACK")).otherwise(F.col("SPIKE_FALLBACK"))
    return out.withColumn("SPIKE_FALLBACK", fallback)


def cascade_routing(p_occurs: Column, p_spike: Column, normal: Column, spike: Column, mode: str = "soft",
                    occurs_at: float = 0.5, spike_at: float = 0.5) -> Column:
    """Blend the regimes by probability, or take one by thresholds."""
    if mode == "hard":
        return F.when(p_occurs < occurs_at, 0.0).when(p_spike < spike_at, normal).otherwise(spike)
    return p_occurs * ((1.0 - p_spike) * normal + p_spike * spike)


def spike_cascade(training: DataFrame, inference: DataFrame, quantile: float = 0.90, mode: str = "soft",
                  min_rows: int = 10, classifier: str = "gbt", keys=(EVAL,), **budget) -> DataFrame:
    """Occurrence, spike given occurrence, and the amount in each regime, fitted together.

    A regime with fewer than ``min_rows`` rows predicts its fallback mean.
    """
    keys, names = list(keys), feature_names(inference)
    labels = cascade_labels(training, quantile, keys)
    y = F.coalesce(F.col(TARGET), F.lit(0.0))
    cut = F.coalesce("SPIKE_THRESHOLD", F.lit(float("inf")))
    rows = training.join(labels.select(*keys, "SPIKE_THRESHOLD"), keys).withColumns({
        "_occurs": (y > 0).cast("double"), "_spike": (y > cut).cast("double"), "_some": y > 0, "_low": (y > 0) & (y <= cut), "_high": y > cut})
    kind = CLASSIFIERS[classifier]
    heads = {"_po": Head("_occurs", **kind), "_ps": Head("_spike", where="_some", **kind), "_normal": Head(TARGET, where="_low"), "_big": Head(TARGET, where="_high")}
    scored = fit_predict(rows, inference, heads, keys, names, **budget)
    known = scored.join(labels.drop("SPIKE_THRESHOLD"), keys, "left")
    enough = lambda count, value, other: F.when(F.coalesce(count, F.lit(0)) >= min_rows, F.col(value)).otherwise(F.coalesce(other, F.lit(0.0)))
    normal = enough(F.col("NORMALS"), "_normal", F.col("NORMAL_FALLBACK"))
    big = enough(F.col("SPIKES"), "_big", F.col("SPIKE_FALLBACK"))
    c = cascade_routing(F.col("_po"), F.col("_ps"), normal, big, mode)
    return known.withColumn(PREDICTION, c).select(*inference.columns, PREDICTION)


# --- ridge for all folds in one job ---------------------------------------------------------


def ridge(training: DataFrame, inference: DataFrame, names: list[str], alpha: float = 1.0, label: str = TARGET, keys=(EVAL,)) -> DataFrame:
    """L2 regression with free intercept: Gram sums per fold combine on the map side, and each
    fold solves one small system whose size is the number of features."""
    keys, k = list(keys), len(names)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names] + [F.coalesce(F.col(label).cast("double"), F.lit(0.0))]
    sums = [F.count("*").cast("double").alias("n")]
    sums += [F.sum(x[i]).alias(f"s{i}") for i in range(k + 1)]
    sums += [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    gram = training.groupBy(*keys).agg(*sums)
    types = dict(training.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", _coef array<double>, _intercept double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            n = r["n"]
            mean = np.array([r[f"s{i}"] for i in range(k + 1)]) / n
            full = np.zeros((k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    full[i, j] = full[j, i] = r[f"g{i}_{j}"] - n * mean[i] * mean[j]
            coef = np.linalg.solve(full[:k, :k] + alpha * np.eye(k), full[:k, k]) if k else np.zeros(0)
            rows.append([r[c] for c in keys] + [coef.tolist(), float(mean[k] - coef @ mean[:k])])
        return pd.DataFrame(rows, columns=[*keys, "_coef", "_intercept"])

    # One Gram row per fold, in batches of rows: no group is larger than a batch.
    solved = gram.mapInPandas(lambda batches: (solve(b) for b in batches), schema)
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    dot = F.aggregate(F.zip_with("_coef", values, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return inference.join(solved, keys).withColumn(PREDICTION, F.col("_intercept") + dot).drop("_coef", "_intercept")


# --- stacking -------------------------------------------------------------------------------


def oof_folds(training: DataFrame, max_folds: int = 5, min_train: int = 90, validation: int = 14, step: int = 14, keys=(EVAL,)) -> DataFrame:
    """Expanding inner folds per outer fold; only the last max_folds are kept."""
    keys = list(keys)
    span = training.groupBy(*keys).agg(F.min(CUTOFF).alias("_lo"), F.max(CUTOFF).alias("_hi"))
    first = F.date_add("_lo", min_train - 1)
    last = F.date_sub("_hi", 1)
    ends = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.make_dt_interval(days=F.lit(step)))).otherwise(F.array().cast("array<date>"))
    kept = F.slice(ends, F.greatest(F.lit(1), F.size(ends) - max_folds + 1), max_folds)
    folds = span.select(*keys, "_hi", F.explode(kept).alias("TRAIN_END"))
    return folds.select(
        *keys, "TRAIN_END", F.date_add("TRAIN_END", 1).alias("VALIDATION_START"),
        F.least(F.date_add("TRAIN_END", validation), F.col("_hi")).alias("VALIDATION_END"))


def base_column(alias: str) -> str:
    return f"BASE_{alias.upper()}_PREDICTION"


def oof_features(training: DataFrame, folds: DataFrame, bases: dict[str, Callable], keys=(EVAL,), passthrough=()) -> DataFrame:
    """Base forecasts on validation rows, each fitted on the inner training rows only.

    Inner folds become extra keys, so all of them are predicted in one job per base model.
    """
    keys = list(keys)
    inner = [*keys, "TRAIN_END"]
    rows = training.join(folds, keys)
    fit = rows.filter(F.col(CUTOFF) <= F.col("TRAIN_END"))
    check = rows.filter(F.col(CUTOFF).between(F.col("VALIDATION_START"), F.col("VALIDATION_END")))
    return base_features(fit, check, bases, inner, passthrough)


def base_features(fit: DataFrame, rows: DataFrame, bases: dict[str, Callable], keys, passthrough=()) -> DataFrame:
    """One column per base forecast and per feature passed through, aligned on the row."""
    index = [*keys, CUTOFF, FORECAST]
    out = rows.select(*index, TARGET, *passthrough)
    for alias, model in bases.items():
        p = model(fit, rows, keys=tuple(keys)).select(*index, F.col(PREDICTION).alias(base_column(alias)))
        out = out.join(p, index)
    return out


def stacking(training: DataFrame, inference: DataFrame, bases: dict[str, Callable], passthrough=(),
             alpha: float = 1.0, min_rows: int = 30, **oof) -> DataFrame:
    """Out-of-fold base forecasts train a ridge; refitted bases feed it at the evaluation cutoff.

    A base is called as model(fit, rows, keys=...); inner folds are more keys of the same job.
    ``passthrough`` names features that the ridge is fitted on beside the base forecasts.
    """
    folds = oof_folds(training, **oof)
    meta = oof_features(training, folds, bases, passthrough=passthrough)
    enough = meta.groupBy(EVAL).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows).select(EVAL)
    meta = meta.join(enough, EVAL, "left_semi")
    at_eval = base_features(training, inference, bases, [EVAL], passthrough)
    return ridge(meta, at_eval, [*[base_column(a) for a in bases], *passthrough], alpha)


# --- intervals and user models --------------------------------------------------------------


def coverage_label(coverage: float) -> str:
    """0.8 -> 80, 0.975 -> 97_5"""
    return f"{coverage * 100:.10g}".replace(".", "_")


def prediction_intervals(training: DataFrame, predictions: DataFrame, fitted: Column, coverages=(0.8, 0.95), keys=(EVAL,)) -> DataFrame:
    """Lower and upper bounds from quantiles of the training residuals of each fold; the point
    forecast where a fold has no residuals. ``fitted`` is the in-sample forecast of a training row."""
    keys = list(keys)
    residual = F.col(TARGET) - fitted
    bounds = []
    for c in coverages:
        bounds += [F.percentile(residual, (1 - c) / 2).alias(f"_lo_{coverage_label(c)}"), F.percentile(residual, (1 + c) / 2).alias(f"_hi_{coverage_label(c)}")]
    joined = predictions.join(training.groupBy(*keys).agg(*bounds), keys, "left")
    shift = lambda side, c: F.col(PREDICTION) + F.coalesce(F.col(f"_{side}_{coverage_label(c)}"), F.lit(0.0))
    columns = {}
    for c in coverages:
        columns[f"PREDICTION_LOWER_{coverage_label(c)}"] = shift("lo", c)
        columns[f"PREDICTION_UPPER_{coverage_label(c)}"] = shift("hi", c)
    return joined.withColumns(columns).drop(*[c for c in joined.columns if c.startswith(("_lo_", "_hi_"))])


def quantile_shift_runs(training: DataFrame, predictions: DataFrame, fitted: Column, quantiles: dict[str, float], keys=(EVAL,)) -> DataFrame:
    """One run per quantile: point forecast plus that quantile of the training residuals."""
    keys = list(keys)
    points = F.array(*[F.struct(F.lit(n).alias("CUSTOM_NAME"), F.lit(q).alias("q")) for n, q in quantiles.items()])
    cut = training.groupBy(*keys).agg(F.percentile(F.col(TARGET) - fitted, F.array(*[F.lit(q) for q in quantiles.values()])).alias("_r"))
    rows = predictions.join(cut, keys).select("*", F.posexplode(points).alias("_i", "_p"))
    return rows.withColumns({PREDICTION: F.col(PREDICTION) + F.get("_r", F.col("_i")), "CUSTOM_NAME": F.col("_p.CUSTOM_NAME")}).drop("_r", "_i", "_p")


def quantile_runs(training: DataFrame, inference: DataFrame, quantiles: dict[str, float], keys=(EVAL,), **budget) -> DataFrame:
    """One run per quantile: trees boosted on the pinball loss, leaves that hold that quantile of their residuals.

    All quantiles of a fold are fitted together and put in order, so no two of them cross.
    """
    names = sorted(quantiles, key=quantiles.get)
    heads = {f"_q{i}": Head(TARGET, "pinball", q=quantiles[n]) for i, n in enumerate(names)}
    fitted = fit_predict(training, inference, heads, keys, **budget)
    fitted = fitted.withColumn("_s", F.array_sort(F.array(*heads))).drop(*heads)
    points = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("n"), F.col("_s").alias("p"))
    rows = fitted.withColumn("_p", F.explode(points))
    return rows.withColumns({PREDICTION: F.col("_p.p"), "CUSTOM_NAME": F.col("_p.n")}).drop("_s", "_p")


def custom_model(training: DataFrame, inference: DataFrame, fit_predict: Callable[[pd.DataFrame, pd.DataFrame], pd.Series], keys=(EVAL,)) -> DataFrame:
    """User model per (sequence, fold): pandas frames of one training window and its evaluation row."""
    keys = list(keys)
    types = dict(inference.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + f", {PREDICTION} double"

    def run(key, train: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.assign(**{PREDICTION: pd.Series(dtype=float)})
        return rows.assign(**{PREDICTION: np.asarray(fit_predict(train, rows), dtype=float)})

    training = training.toDF(*training.columns)  # both sides may come from the same features
    return training.groupBy(*keys).cogroup(inference.groupBy(*keys)).applyInPandas(run, schema)


