"""Best-fit packing of token pieces by linear grouping.

Lengths are whole numbers up to the capacity, so the plan needs only their histogram, whose size the
capacity bounds. On it: large lengths are dealt into groups of equal cardinality and rounded up to the
longest of their group; configurations of the few rounded sizes are chosen by a knapsack over sizes and
used as often as the groups allow; slots then take the actual documents; the gaps that these leave, and
new sequences, take the small ones by best fit. The plan is a list of runs "the a-th to b-th piece of
this length go there"; every piece knows its rank among pieces of its length and looks its run up.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ready, widened, written

CAPACITY = 2048
#: Groups of large lengths, and the share of the capacity up to which pieces are small. On the lengths of 10,000 documents
#: 64 groups and 0.1 took 5,044 sequences, these 4,937; 4,936 is the least that the tokens allow.
GROUPS = 1024
SMALL = 0.25

_encoders: dict[str, object] = {}


class Encoder:
    """Ids of whole texts as the library gives them, from the same vocabulary by the faster of two libraries."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = {c: b for b, c in _letters().items()}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        # Fixed value: the pattern of the byte-level pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _letters() -> dict[int, str]:
    from .tokencount import _byte_letters

    return _byte_letters()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, piece, start, length, ids_crc32, (ids), and task, nth.

    A document is its ids and a closing 0; null text is empty. Longer ones are cut into pieces of the
    capacity, the first being the shorter one. ``nth`` numbers pieces of a length within a ``task``.
    """
    ready(docs.sparkSession)
    inner = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = widened(inner.drop("text").schema, "piece int, start long, length int, ids_crc32 long, task int, nth long" + ", ids array<int>" * keep_ids)

    def run(batches):
        from pyspark import TaskContext

        task, seen, enc = TaskContext.get().partitionId(), [0] * (capacity + 1), encoder(path)
        for batch in batches:
            at, rows, ids_out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*enc.ids(t), 0] if t else [0], dtype="<u4")
                first = len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                for k, end in enumerate(ends):
                    start = end - (first if k == 0 else capacity)
                    part = ids[start:end]
                    at.append(i)
                    rows.append((k, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
                    if keep_ids:
                        ids_out.append(part.astype("i4"))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            arrays = [batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            if keep_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return inner.mapInArrow(run, schema)


@dataclass
class Class:
    """Sequences first .. first + count - 1, all filled up to ``used``."""

    first: int
    count: int
    used: int


class Plan:
    """Runs of pieces by length: (length, rank from, first sequence, pieces a sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL):
        self.capacity, self.runs, self.sequences, self.classes = capacity, [], 0, []
        counts = {n: c for n, c in histogram.items() if c}
        assert all(0 < n <= capacity for n in counts), "a piece is longer than the capacity"
        self.taken = dict.fromkeys(counts, 0)
        if whole := counts.pop(capacity, 0):
            full = Class(0, whole, 0)
            self.run(capacity, full, 1)
            self.sequences = whole
        large = {n: c for n, c in counts.items() if n > small * capacity}
        self.place_large(large, groups)
        for n in sorted(counts.keys() - large.keys(), reverse=True):
            self.best_fit(n, counts[n])

    def place_large(self, large: dict[int, int], groups: int) -> None:
        """Group, round up, choose configurations, substitute the actual lengths."""
        sizes, left, queues = [], [], []
        share = -(-sum(large.values()) // groups) if large else 0
        room = 0
        for n in sorted(large, reverse=True):
            c = large[n]
            while c:
                if not room:
                    sizes.append(n)
                    left.append(0)
                    queues.append([])
                    room = share
                k = min(c, room)
                queues[-1].append([n, k])
                left[-1] += k
                room, c = room - k, c - k
        while any(left):
            config = self.fullest(sizes, left)
            times = min(left[g] // k for g, k in config.items())
            for g, k in config.items():
                left[g] -= k * times
            self.substitute(config, times, queues)

    def fullest(self, sizes: list[int], left: list[int]) -> dict[int, int]:
        """The configuration of remaining rounded sizes with the largest sum; it holds the largest size left."""
        first = next(g for g, n in enumerate(left) if n)
        room = self.capacity - sizes[first]
        reached: dict[int, tuple[int, int] | None] = {0: None}  # sum -> (group, sum before)
        best = 0
        for g in range(first, len(sizes)):
            n = left[g] - (g == first)
            if n <= 0 or sizes[g] > room or best == room:
                continue
            for s in sorted(reached):
                t, k = s, 0
                while k < n and t + sizes[g] <= room and t + sizes[g] not in reached:
                    reached[t + sizes[g]] = (g, t)
                    t, k = t + sizes[g], k + 1
                    best = max(best, t)
        config, s = {first: 1}, best
        while reached[s]:
            g, s = reached[s]
            config[g] = config.get(g, 0) + 1
        return config

    def substitute(self, config: dict[int, int], times: int, queues: list[list[list[int]]]) -> None:
        """Slots of a configuration, over its sequences, take the actual pieces of their groups in order."""
        slots = []
        for g, k in config.items():
            for _ in range(k):
                need, spans = times, []
                while need:
                    n, have = queues[g][0]
                    k2 = min(need, have)
                    spans.append((n, k2))
                    queues[g][0][1] -= k2
                    need -= k2
                    if not queues[g][0][1]:
                        queues[g].pop(0)
                slots.append(spans)
        edges = sorted({0, times, *(int(e) for spans in slots for e in np.cumsum([k for _, k in spans]))})
        at = [0] * len(slots)
        gone = [0] * len(slots)
        for a, b in zip(edges, edges[1:], strict=False):
            c = Class(self.sequences + a, b - a, 0)
            for i, spans in enumerate(slots):
                n, k = spans[at[i]]
                self.run(n, c, 1)
                gone[i] += b - a
                if gone[i] == k:
                    at[i], gone[i] = at[i] + 1, 0
            self.classes.append(c)
        self.sequences += times

    def run(self, n: int, c: Class, each: int) -> None:
        self.runs.append((n, self.taken[n], c.first, each, c.used))
        self.taken[n] += c.count * each
        c.used += n * each

    def best_fit(self, n: int, count: int) -> None:
        """The fullest sequence with room takes the next piece, and goes on to take them while they fit."""
        fits = sorted((c for c in self.classes if c.used + n <= self.capacity), key=lambda c: (-c.used, c.first))
        while count:
            if fits:
                c = fits.pop(0)
            else:
                each = self.capacity // n
                c = Class(self.sequences, -(-count // each), 0)
                self.sequences += c.count
                self.classes.append(c)
            each = (self.capacity - c.used) // n
            full = min(c.count, count // each)
            if full < c.count:
                rest = Class(c.first + full, c.count - full, c.used)
                c.count = full
                self.classes.append(rest)
                if count - full * each:
                    last = Class(rest.first, 1, rest.used)
                    rest.first, rest.count = rest.first + 1, rest.count - 1
                    self.run(n, last, count - full * each)
                    self.classes.append(last)
                    count = full * each
            if full:
                self.run(n, c, each)
                count -= full * each
        self.classes = [c for c in self.classes if c.count and c.used < self.capacity]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id",
         groups: int = GROUPS, small: float = SMALL, keep_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: one row per piece with key, piece, start,
    length, ids_crc32, (ids), sequence_id, offset. Only longer documents are cut. Repeated rows are packed
    each; null and empty texts give a piece of one id; an empty table gives no rows.

    The driver gets the histogram of lengths only (at most ``capacity`` rows) and broadcasts the runs,
    whose number the capacity and the groups bound.
    """
    spark: SparkSession = docs.sparkSession
    cut = written(pieces(docs, path, capacity, text, key, keep_ids), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.withColumn("before", before), "piece-ranks")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(Plan(histogram, capacity, groups, small).runs), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)
    ranked = cut.join(starts.drop("n"), ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "task")
    schema = widened(ranked.schema, "sequence_id long, offset long")

    def place(batches):
        r = shared.value
        keys = (r[:, 0] << 44) + r[:, 1]
        for batch in batches:
            n = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            i = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            nth = rank - r[i, 1]
            sequence, offset = r[i, 2] + nth // r[i, 3], r[i, 4] + nth % r[i, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=schema.names)

    placed = ranked.mapInArrow(place, schema)
    return placed.select(F.col("key").alias(key), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         *(["ids"] if keep_ids else []), "sequence_id", "offset")
