"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

A document is known by the set of filters that it fails, a mask of five bits. Documents are counted by
part and mask (32 masks at most), weighted by rows, good and toxic labels; only these counts meet the
orders. For each part, the mask matrix (0 where a mask fails a filter, infinite elsewhere) and the
inverse-permutation matrix (the position of each filter in each of the 120 orders) are combined by
min-plus: the least sum over the filters is the step at which an order removes a mask. Counts are then
weighted scatters of the masks by removal step.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
# The characters that filters C and D count.
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: str, raw: bytes) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    ws = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(ws) < MIN_WORDS) | (100 * len(set(ws)) < MIN_DISTINCT * len(ws)) << 1
            | (100 * capitals > MAX_CAPITALS * len(text)) << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def masks(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Rows (id, part, digest, mask): the digest stands for the whole text, the mask for filters A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, mask = [], []
            for t in batch.column("t"):
                t = t.as_py() or ""
                raw = t.encode("utf-8", "surrogatepass")
                digest.append(hashlib.blake2b(raw, digest_size=16).digest())
                mask.append(text_mask(t, raw))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(digest, pa.binary()), pa.array(mask, pa.int32())],
                                             names=["id", "part", "digest", "mask"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic) with all five bits.

    E (bit 4) fails if the text is that of a smaller key anywhere. Counted as all rows less those with the
    smallest key of their text, so that no text's rows meet in one place: copies are pre-aggregated by
    (text, key), and that is also the key of the only join.
    """
    ready(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    marks = marks.filter("id IS NOT NULL").groupBy("id").agg(*[F.max(F.coalesce(c, F.lit(False)).cast("long")).alias(c) for c in ("g", "t")])
    found = masks(docs, text, key, part).groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n"))
    rows = written(found.join(marks, "id", "left").select("digest", "id", "part", "mask", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("g", "t")]), "masks")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL")
    clean = rows.join(first, ["digest", "id"], "left_semi").unionByName(rows.filter("id IS NULL"))  # a row without a key has no smaller one
    sums = [F.sum(c).alias(c) for c in ("n", "g", "t")]
    totals = rows.groupBy("part", "mask").agg(*sums)
    kept = clean.groupBy("part", "mask").agg(*sums)
    less = kept.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "g", "t")])
    copies = totals.unionByName(less).groupBy("part", "mask").agg(*sums).withColumn("mask", F.col("mask").bitwiseOR(F.lit(16)))
    return kept.unionByName(copies).select("part", "mask", "n", F.col("g").alias("good"), F.col("t").alias("toxic"))


def removal_steps() -> tuple[np.ndarray, np.ndarray]:
    """(position of each filter in each order, 5 x 120; step that removes each mask in each order, 32 x 120, infinite if none)."""
    position = np.array([[order.index(f) + 1 for order in ORDERS] for f in FILTERS], dtype=float)
    fails = np.arange(32)[:, None] >> np.arange(5) & 1
    return position, (np.where(fails, 0, np.inf)[:, :, None] + position).min(axis=1)


def audit_of(weights: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of one part as arrays (120 orders, 5 steps), from weights (32 masks; rows, good, toxic)."""
    position, step = removal_steps()
    place = position.astype(np.int64) - 1
    orders = np.arange(len(ORDERS))
    at = np.where(np.isinf(step), 5, step - 1).astype(np.int64)  # 5: never removed
    lost = np.zeros((3, len(ORDERS), 6), dtype=np.int64)
    for k in range(3):
        np.add.at(lost[k], (np.broadcast_to(orders, at.shape), at), np.broadcast_to(weights[:, k, None], at.shape))
    redundant, unique, shapley = (np.zeros((len(ORDERS), 5), dtype=np.int64) for _ in range(3))
    for f in range(5):
        failing = np.arange(32)[:, None] >> f & 1
        redundant[orders, place[f]] = (weights[:, :1] * (failing & (at < place[f]))).sum(axis=0)
        unique[orders, place[f]] = weights[1 << f, 0]
        shapley[orders, place[f]] = lost[0][orders, place[f]].sum()
    removed = lost[0][:, :5]
    return {"kept": weights[:, 0].sum() - removed.cumsum(axis=1), "removed": removed, "redundant": redundant, "unique_fails": unique,
            "good_lost": lost[1][:, :5], "toxic_lost": lost[2][:, :5], "shapley": shapley}


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row per part, filter_order and step with COUNTS, zeros included.

    Null texts are empty; a null part is the empty string. Several labels of one key count as one, good or toxic if
    any is. Repeated rows count each; equal texts under one key are no copies of each other. A row
    without a key is no copy of any row, and none is one of it. Other columns are not read. An empty table gives no rows.
    """

    def run(table: pa.Table) -> pa.Table:
        weights = np.zeros((32, 3), dtype=np.int64)
        np.add.at(weights, table.column("mask").to_numpy(), np.stack([table.column(c).to_numpy() for c in ("n", "good", "toxic")], axis=1))
        counts = audit_of(weights)
        size = len(ORDERS) * 5
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py()] * size, pa.string()),
            "filter_order": pa.array([o for o in ORDERS for _ in range(5)], pa.string()),
            "step": pa.array(np.tile(np.arange(1, 6), len(ORDERS)), pa.int32()),
            **{c: pa.array(counts[c].reshape(-1), pa.int64()) for c in COUNTS},
        })

    counted = mask_counts(docs, labels, text, key, part)  # at most 32 masks, twice, in a group
    return counted.groupBy("part").applyInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")
