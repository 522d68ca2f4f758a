"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over features of words (the word and its
letter 4- and 5-grams, counted); each model also sees the probabilities of the earlier categories.
In training those come from models that did not see the row (out-of-fold), so that a later model meets
the same kind of input as in use.

A text is judged by windows: WINDOW words each, every second half shared with the next, so that all of a
long text is seen. The chain is fitted on windows as well. A text takes the highest log-odds of its windows,
less the logarithm of their number: among n windows one is n times as likely to look toxic by chance.

The labels name one category, toxic. The chain has three: toxic rows with a listed insult (explicit),
toxic rows without one (coded: other languages, made-up or veiled words), and toxic, which decides.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, written

CATEGORIES = ("explicit", "coded", "toxic")
#: Common English insults; they only split the labelled toxic rows into two categories.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting fool jerk imbecile".split())
#: Labelled rows that a model is fitted on, at most, and windows of each of them.
SAMPLE, OF_EACH = 8_000, 2
#: Words of a window (an even number); longer words are cut into parts of WORD letters.
WINDOW, WORD = 256, 200
FEATURES = 512
BUCKETS = 1 << 22
FOLDS = 5
RIDGE = 0.3
LEAST_ROWS = 3
THRESHOLD = 0.5
#: Tokens that a worker keeps: few of them have features in use, but all have some while these are counted.
CACHED, CACHED_WHOLE = 250_000, 60_000
_WORD = re.compile(r"[^\W\d_]+")


def features(token: str) -> set[int]:
    """Hashed features of one blank-separated token: its words and their letter 4- and 5-grams."""
    out = set()
    for w in _WORD.findall(token):
        out.add(zlib.crc32(b"w" + w.encode()) % BUCKETS)
        padded = f"^{w}$"
        for n in (4, 5):
            out.update(zlib.crc32(padded[i : i + n].encode()) % BUCKETS for i in range(len(padded) - n + 1))
    return out


class Kept(dict):
    """Token -> its features among those in use; a bounded cache of one worker."""

    def __init__(self, ids: dict[int, int] | None = None):
        super().__init__()
        self.ids = ids

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= (CACHED_WHOLE if self.ids is None else CACHED):
            self.clear()
        got = features(token)
        value = self[token] = tuple(got) if self.ids is None else tuple(self.ids[f] for f in got if f in self.ids)
        return value

    def of(self, tokens: list[str]) -> list[int]:
        """Features of a half window, each as often as different tokens have it."""
        return list(chain.from_iterable(map(self.__getitem__, set(tokens))))


def halved(text: str | None) -> list[list[str]]:
    """The words of a text by half windows; a remainder below a quarter window belongs to the last half."""
    tokens = (text or "").lower().split()
    if text and len(text) > WORD and max(map(len, tokens), default=0) > WORD:
        tokens = [t[i : i + WORD] for t in tokens for i in range(0, len(t), WORD)]
    half = WINDOW // 2
    starts = list(range(0, len(tokens), half))
    if len(starts) > 1 and len(tokens) - starts[-1] < half // 2:
        starts.pop()
    return [tokens[i:j] for i, j in zip(starts, [*starts[1:], len(tokens)])]


def explicit(tokens: list[str]) -> bool:
    return any(w in INSULTS for t in set(tokens) for w in _WORD.findall(t))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic model, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        bend[np.diag_indices_from(bend)] += penalty
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class Chain:
    """Feature bucket -> column, and the weights of each link: features, earlier probabilities, intercept."""

    ids: dict[int, int] = field(default_factory=dict)
    links: list[np.ndarray] = field(default_factory=list)

    def predict(self, texts: list[list[list[int]]]) -> np.ndarray:
        """Probabilities by text and category, of texts as the features of their half windows; zeros without a fitted model."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        if not self.links or not texts:
            return out
        sizes = np.array([max(len(t), 1) for t in texts])
        halves = [h for t in texts for h in t or [[]]]
        owner = np.repeat(np.arange(len(halves)), [len(h) for h in halves])
        column = np.fromiter((c for h in halves for c in h), dtype=np.int64, count=len(owner))
        last = np.cumsum(sizes) - 1
        lone = sizes == 1
        follows = np.ones(len(halves), dtype=bool)  # the half windows that start a window
        follows[last[~lone]] = False
        count = np.where(lone, 1, sizes - 1)
        first = np.cumsum(count) - count
        n, z = len(self.ids), np.zeros((int(count.sum()), len(CATEGORIES)))
        for k, w in enumerate(self.links):
            half = np.bincount(owner, weights=w[column], minlength=len(halves))
            pair = half + np.append(half[1:], 0)
            pair[last[lone]] = half[last[lone]]
            z[:, k] = pair[follows] + w[-1] + _sigmoid(z[:, :k]) @ w[n : n + k]
        return _sigmoid(np.maximum.reduceat(z, first) - np.log(count)[:, None])


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """One link per category; earlier categories enter as out-of-fold probabilities."""
    links, earlier = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        full = np.hstack([x, earlier])
        held = np.zeros(len(x))
        for f in range(FOLDS):
            inside = fold != f
            if inside.any() and not inside.all():
                w = logistic(full[inside], labels[inside, k], weight[inside])
                held[~inside] = _sigmoid(full[~inside] @ w[:-1] + w[-1])
        links.append(logistic(full, labels[:, k], weight))
        earlier = np.hstack([earlier, held[:, None]])
    return links


def _sample(docs: DataFrame, labels: DataFrame, rows: int, text: str, key: str) -> DataFrame:
    """Windows of at most ``rows`` labelled texts, chosen by hash of the key, OF_EACH evenly spaced ones of each text.

    Repeated labels of a key count as toxic if one is.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    found = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).filter(F.col("_text").isNotNull()).join(marks, key)
    hashed = found.withColumn("_h", F.xxhash64(key, F.lit(17)))
    total = marks.count()
    if total > 2 * rows:  # thin first, so that the exact cut sorts a bounded number of rows
        limit = 2**63 - int(2**64 * (1 - 1.5 * rows / total))
        hashed = hashed.filter(F.col("_h") < limit)
    chosen = hashed.select(key, "_h").orderBy("_h", key).limit(rows).select(F.col(key)).distinct()
    texts = hashed.join(F.broadcast(chosen), key, "left_semi")

    def cut(batches):
        for batch in batches:
            for t, y, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                halves = halved(t)
                windows = list(zip(halves, halves[1:])) if len(halves) > 1 else [(halves[0] if halves else [], [])]
                share = min(len(windows), OF_EACH)
                taken = [windows[(h + len(windows) * i // share) % len(windows)] for i in range(share)]
                yield pa.RecordBatch.from_pydict({
                    "_window": pa.array([a + b for a, b in taken], pa.list_(pa.string())), "_n": pa.array([len(a) for a, _ in taken], pa.int32()),
                    "_toxic": pa.array([y] * share, pa.int32()), "_h": pa.array([h] * share, pa.int64())})

    return written(texts.select("_text", "_toxic", "_h").mapInArrow(cut, "_window array<string>, _n int, _toxic int, _h long"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, size: int = FEATURES, text: str = "text", key: str = "doc_id") -> Chain:
    """A chain fitted on a bounded sample of labelled rows.

    Features are counted by label in Spark; those that differ most (chi-square) are kept. The driver gets
    the kept columns of the sample only. Without toxic or without clean labelled rows nothing is fitted,
    and no document is toxic.
    """
    spark: SparkSession = docs.sparkSession
    ready(spark)
    sample = _sample(docs, labels, rows, text, key)

    def count(batches):
        kept, seen = Kept(), (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for t, y in zip(batch.column("_window").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                seen[y > 0].update(set(kept.of(t)))
                n[y > 0] += 1
        for y in (0, 1):
            f = np.fromiter(seen[y].keys(), np.int64, len(seen[y]))
            c = np.fromiter(seen[y].values(), np.int64, len(seen[y]))
            yield pa.RecordBatch.from_pydict({"f": np.append(f, -1), "y": np.full(len(f) + 1, y), "n": np.append(c, n[y])})

    counts = sample.select("_window", "_toxic").mapInArrow(count, "f long, y long, n long").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    counts = written(counts, "toxicity-features")
    total = counts.filter("f = -1").first()
    if total is None or not total["a"] or not total["b"]:
        return Chain()
    na, nb = total["a"], total["b"]
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (a * (nb - b) - b * (na - a)) ** 2 / ((a + b) * (na + nb - a - b) + 1)
    best = counts.filter((F.col("f") >= 0) & (F.col("a") + F.col("b") >= LEAST_ROWS)).orderBy(F.desc(chi), "f").limit(size).collect()
    ids = {r["f"]: i for i, r in enumerate(best)}

    def project(batches):
        kept = Kept(ids)
        for batch in batches:
            windows = batch.column("_window").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([sorted(kept.of(t[:n]) + kept.of(t[n:])) for t, n in zip(windows, batch.column("_n").to_pylist(), strict=True)], pa.list_(pa.int32())),
                "explicit": pa.array([explicit(t) for t in windows]),
                "toxic": pa.array([y > 0 for y in batch.column("_toxic").to_pylist()]), "fold": pa.array([h % FOLDS for h in batch.column("_h").to_pylist()], pa.int32())})

    projected = sample.select("_window", "_n", "_toxic", "_h").mapInArrow(project, "x array<int>, explicit boolean, toxic boolean, fold int")
    got = projected.groupBy("x", "explicit", "toxic", "fold").count().orderBy("fold", "toxic", "explicit", "x").collect()
    x = np.zeros((len(got), len(ids)))
    for i, r in enumerate(got):
        np.add.at(x[i], r["x"], 1)
    y = np.array([[r["toxic"] and r["explicit"], r["toxic"] and not r["explicit"], r["toxic"]] for r in got], dtype=float)
    weight = np.array([r["count"] for r in got], dtype=float)
    return Chain(ids, fit_chain(x, y, np.array([r["fold"] for r in got]), weight))


def judge(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` and p_explicit, p_coded, p_toxic and toxic, from all windows of the whole text.

    Null and empty texts have no features and get the chain's base rates. Repeated rows are judged each; an
    empty table gives no rows; columns named like a result are replaced.
    """
    ready(docs.sparkSession)
    results = [f"p_{c}" for c in CATEGORIES]
    names = [c for c in docs.columns if c not in (*results, "toxic")]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{r} double" for r in results))
    def probabilities(texts: pd.Series) -> pd.DataFrame:
        kept = _kept(shared)
        return pd.DataFrame(shared.value.predict([[kept.of(h) for h in halved(t)] for t in texts]), columns=results)

    out = docs.select(*[F.col(f"`{c}`") for c in names], probabilities(F.col(f"`{text}`").cast("string")).alias("_p"))
    return out.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"_p.{r}").alias(r) for r in results], (F.col("_p.p_toxic") >= threshold).alias("toxic"))


_last: list = []  # the broadcast chain in use by this worker and its token cache


def _kept(shared) -> Kept:
    if not _last or _last[0] is not shared:
        _last[:] = [shared, Kept(shared.value.ids)]
    return _last[1]
