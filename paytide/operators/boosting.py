"""Boosted trees and linear models of many small training windows at once.

A fold's training rows are the days of its window (of one sequence), so their number is a parameter of the
backtest and not of the data. Spark brings each fold's training and evaluation rows together by key; one
job fits all models of all folds, however many folds and rounds there are, and nothing is collected.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backtest import EVAL
from .gold import TARGET
from .pointintime import numeric_feature_columns

#: The reference budget: rounds, learning rate, about 31 leaves, and rows of a leaf at least.
BUDGET = {"rounds": 200, "step": 0.03, "depth": 5, "min_leaf": 20, "bins": 255}


@dataclass(frozen=True)
class Head:
    """One fitted output: a label column, a loss, and a flag column that picks the training rows.

    Losses of trees: squared, pinball (with ``q``), logistic, tweedie (with ``power``). Losses of linear models on scaled
    features: linear_logistic (balanced classes) and linear_tweedie, both with an L2 penalty ``reg``.
    """

    label: str = TARGET
    loss: str = "squared"
    where: str | None = None
    q: float = 0.5
    power: float = 1.5
    reg: float = 0.0


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in numeric_feature_columns(df) if not c.startswith("_")]


# ---- kernels: arrays of one fold --------------------------------------------------------------------


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of a feature: between its distinct values, at most ``bins`` - 1 of them, evenly by rank."""
    values = np.unique(x)
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) >= bins:
        middle = middle[np.linspace(0, len(middle) - 1, bins - 1).astype(int)]
    return middle


def _gradient(loss: str, y: np.ndarray, f: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradient and curvature of the loss at the scores f."""
    if loss == "logistic":
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-12)
    if loss == "pinball":
        return np.where(y > f, head.q, head.q - 1), np.ones_like(y)
    if loss == "tweedie":
        up, top = np.exp((1 - head.power) * f), np.exp((2 - head.power) * f)
        return y * up - top, np.maximum((head.power - 1) * y * up + (2 - head.power) * top, 1e-12)
    return y - f, np.ones_like(y)


def _leaf_quantiles(r: np.ndarray, leaf: np.ndarray, leaves: int, q: float) -> np.ndarray:
    """The interpolated q-quantile of the values of each leaf; 0 for leaves without rows."""
    r = r[np.lexsort((r, leaf))]
    count = np.bincount(leaf, minlength=leaves)
    first = np.minimum(np.cumsum(count) - count, len(r) - 1)
    position = q * np.maximum(count - 1, 0)
    low, high = first + np.floor(position).astype(int), first + np.ceil(position).astype(int)
    return np.where(count > 0, r[low] + (position - np.floor(position)) * (r[high] - r[low]), 0.0)


def boost(x: np.ndarray, y: np.ndarray, new: np.ndarray, head: Head, rounds: int, step: float, depth: int, min_leaf: int, bins: int) -> np.ndarray:
    """Predictions for the rows of ``new``, by histogram trees grown level by level.

    A split takes the largest gain G_l^2 / H_l + G_r^2 / H_r - G^2 / H; of equal ones the first feature and lowest threshold.
    """
    loss, (n, features) = head.loss, x.shape
    cuts = [cut_points(x[:, j], bins) for j in range(features)]
    width = max((len(c) for c in cuts), default=0) + 1
    code = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(features)], axis=1)
    ask = np.stack([np.searchsorted(cuts[j], new[:, j]) for j in range(features)], axis=1)
    slot = code + np.arange(features) * width
    if loss == "logistic":
        start = np.log(y.mean() / (1 - y.mean()))
    elif loss == "tweedie":
        start = np.log(y.mean())
    else:
        start = np.quantile(y, head.q) if loss == "pinball" else y.mean()
    f, out = np.full(n, start), np.full(len(new), start)
    for _ in range(rounds):
        g, h = _gradient(loss, y, f, head)
        node, at = np.zeros(n, np.int64), np.zeros(len(new), np.int64)
        for level in range(depth):
            nodes = 1 << level
            count = np.bincount(node, minlength=nodes)
            live = np.flatnonzero(count >= 2 * min_leaf)  # nodes that can be split
            if not len(live) or width < 2:
                node, at = node << (depth - level), at << (depth - level)
                break
            rank = np.full(nodes, -1)
            rank[live] = np.arange(len(live))
            mine = rank[node] >= 0
            where = ((rank[node[mine]] * features * width)[:, None] + slot[mine]).ravel()
            shape = (len(live), features, width)
            total = [np.bincount(where, np.repeat(v[mine], features), len(live) * features * width).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            gl, hl, cl = (t[:, :, :-1] for t in total)
            gs, hs, cs = (t[:, :, -1:] for t in total)
            fits = (cl >= min_leaf) & (cs - cl >= min_leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, gl**2 / hl + (gs - gl) ** 2 / (hs - hl) - gs**2 / hs, -np.inf).reshape(len(live), -1)
                top = gain.max(axis=1, keepdims=True)
                best = (gain >= top - 1e-9 * np.abs(top)).argmax(axis=1)  # sums differ in their last bits
            won, feature, bin_ = np.zeros(nodes, bool), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
            won[live] = top[:, 0] > 1e-12
            feature[live], bin_[live] = best // (width - 1), best % (width - 1)
            right = lambda c, k: won[k] & (c[np.arange(len(c)), feature[k]] > bin_[k])  # noqa: B023, E731
            node, at = 2 * node + right(code, node), 2 * at + right(ask, at)
        value = _leaf_quantiles(y - f, node, 1 << depth, head.q) if loss == "pinball" else np.bincount(node, g, 1 << depth) / np.maximum(np.bincount(node, h, 1 << depth), 1e-300)
        f, out = f + step * value[node], out + step * value[at]
    if loss == "logistic":
        return 1 / (1 + np.exp(-out))
    return np.exp(out) if loss == "tweedie" else out


def linear(x: np.ndarray, y: np.ndarray, new: np.ndarray, head: Head) -> np.ndarray:
    """Newton steps, halved while the objective does not fall, until they rest: logistic with balanced classes, or Tweedie with a log link."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = lambda v: np.c_[np.ones(len(v)), (v - mean) / np.where(spread > 0, spread, 1)]
    a, logistic = scale(x), head.loss == "linear_logistic"
    unit = 1.0 if logistic else max(y.mean(), 1e-12)
    y, p = y / unit, head.power
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if logistic else np.ones(len(y))
    penalty = head.reg * np.r_[0.0, np.ones(x.shape[1])]
    eta = lambda b: np.clip(a @ b, -30, 30)

    def objective(b: np.ndarray) -> float:
        e = eta(b)
        cost = np.logaddexp(0, e) - y * e if logistic else -y * np.exp((1 - p) * e) / (1 - p) + np.exp((2 - p) * e) / (2 - p)
        return float((weight * cost).mean() + 0.5 * (penalty * b * b).sum())

    b = np.zeros(a.shape[1])
    for _ in range(100):
        e = eta(b)
        if logistic:
            mu = 1 / (1 + np.exp(-e))
            g, h = weight * (mu - y), weight * np.maximum(mu * (1 - mu), 1e-12)
        else:
            up, top = np.exp((1 - p) * e), np.exp((2 - p) * e)
            g, h = top - y * up, np.maximum((p - 1) * y * up + (2 - p) * top, 1e-12)
        move = np.linalg.solve((a.T * h) @ a / len(y) + np.diag(penalty + 1e-12), a.T @ g / len(y) + penalty * b)
        size, now = 1.0, objective(b)
        while objective(b - size * move) > now + 1e-15 and size > 1e-6:
            size /= 2
        b = b - size * move
        if np.abs(size * move).max() < 1e-10:
            break
    e = np.clip(scale(new) @ b, -30, 30)
    return 1 / (1 + np.exp(-e)) if logistic else unit * np.exp(e)


def fit_head(x: np.ndarray, y: np.ndarray, new: np.ndarray, head: Head, budget: dict) -> np.ndarray:
    """One model; where there is too little to fit: the mean label, the class rate, or zero without rows."""
    if "tweedie" in head.loss:
        y = np.maximum(y, 0.0)
    if len(y) < 2 or not x.shape[1] or ("logistic" in head.loss and len(np.unique(y)) < 2) or ("tweedie" in head.loss and not y.any()):
        level = np.quantile(y, head.q) if head.loss == "pinball" and len(y) else y.mean() if len(y) else 0.0
        return np.full(len(new), level)
    if head.loss.startswith("linear"):
        return linear(x, y, new, head)
    return boost(x, y, new, head, **budget)


# ---- Spark -----------------------------------------------------------------------------------------


def fit_predict(training: DataFrame, rows: DataFrame, heads: dict[str, Head], keys=(EVAL,), names=None, **budget) -> DataFrame:
    """``rows`` with one column per head, each fitted on the training rows of the same keys.

    Missing features are 0; training rows without a label are left out; rows whose keys have no training rows get 0.
    """
    keys = list(keys)
    names = list(names if names is not None else [c for c in feature_names(rows) if c in training.columns])
    budget = BUDGET | budget
    labels = sorted({h.label for h in heads.values()})
    flags = sorted({h.where for h in heads.values() if h.where})
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    own = [c for c in labels if c not in names]
    fit = training.select(*keys, *[number(c) for c in names], *[F.col(c).cast("double").alias(c) for c in own], *[F.col(c).cast("boolean").alias(c) for c in flags])
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + "".join(f", `{c}` double" for c in heads)

    def run(train: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        new = ask[names].apply(pd.to_numeric).fillna(0.0).to_numpy(float)
        columns = {}
        for name, head in heads.items():
            use = train[head.label].notna() & (train[head.where].fillna(False).astype(bool) if head.where else True)
            part = train[use]
            columns[name] = fit_head(part[names].to_numpy(float), part[head.label].to_numpy(float), new, head, budget) if len(ask) else np.zeros(0)
        return ask.assign(**columns)

    # A fold is little data and much work: a stated number of partitions keeps small ones from being merged.
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    fit = fit.toDF(*fit.columns).repartition(parts, *keys)  # both sides may come from the same features
    return fit.groupBy(*keys).cogroup(rows.repartition(parts, *keys).groupBy(*keys)).applyInPandas(run, schema)
