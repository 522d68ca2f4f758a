"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in at most 3 bits, joined to components.

1. Fingerprint of a whole text: the words are lower-cased (A-Z) and cut into 3-word shingles, repeats
   included; a bit is 1 if more than half of the shingles' XXH64 values have it.
2. Embedding: the 64 bits are 32 segments of two bits; the popcounts of the segments are a point of a grid.
   The Manhattan distance of two points is a lower bound of the Hamming distance. A popcount of 0, 1, 2 is
   kept in unary (00, 01, 11), so that a point is one long and the distance is the popcount of an XOR.
3. Grid range-join: the segments are dealt to ``groups`` groups. A distance of 3 changes three groups at
   most, so two points within the range agree on all coordinates of some choice of ``groups`` - 3 groups.
   Each distinct fingerprint is put into one grid cell per choice; points that meet in a cell are tested
   by Manhattan distance, then exactly by Hamming distance. More groups mean more rows and finer cells;
   the number of distinct fingerprints decides.
4. A cell of more than LIMIT points (many slight variants of one text) is never searched in pairs: its points
   go into cells of 5 equal bytes of 8 (3 bits differ in 3 bytes at most). A cell still larger has 24 free
   bits, so it holds 2^24 points at most, and each point looks up the at most 2,324 points that
   1 to 3 flips of the free bits give. No point is dropped.

Cells emit links that join components only, never all pairs of a group.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, written
from .ngram_join import components

WIDTH, SEED, DISTANCE = 3, 42, 3
SEGMENTS = 32
#: Points of a cell that are compared with each other in one task.
LIMIT = 4_096
#: Runs up to this length are compared all at once, by offset.
SHORT_RUN = 32
#: Points of unlike texts that a point is to meet at most, on average, over all its cells.
MET = 100
#: Shingles that are hashed at a time.
HASHED = 65_536
#: Rows of one fingerprint above which it is joined by broadcast; at most 1,000 fingerprints have so many.
HOT_ROWS, HOT_SHARE = 10_000, 1_000

_EVEN = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text, unsigned; 0 for a text without words."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(len(ws) - WIDTH + 1, 1)
    last = ends[min(WIDTH, len(ws)) - 1 :]
    set_bits = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, HASHED):
        cut = zip(starts[i : min(i + HASHED, n)].tolist(), last[i : i + HASHED].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in cut], dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (id, f): the key as a long and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py()) for t in batch.column("t")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(f, pa.int64())], names=["id", "f"])

    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    return texts.mapInArrow(run, "id long, f long")


# ---- embedding and cells ---------------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def embedding(f: Column) -> Column:
    """The popcounts of the segments in unary, two bits each."""
    half, even = F.shiftrightunsigned(f, 1), F.lit(_EVEN)
    return f.bitwiseOR(half).bitwiseAND(even).bitwiseOR(F.shiftleft(f.bitwiseAND(half).bitwiseAND(even), 1))


def embedded(f: np.ndarray) -> np.ndarray:
    """The same as ``embedding`` for an array of unsigned longs."""
    half, even = f >> np.uint64(1), np.uint64(_EVEN)
    return ((f | half) & even) | ((f & half & even) << np.uint64(1))


def choices(parts: list[int]) -> list[int]:
    """Masks of all but DISTANCE of the parts (masks that cover 64 bits), signed."""
    return [_signed(sum(kept)) for kept in itertools.combinations(parts, len(parts) - DISTANCE)]


def grid_masks(groups: int) -> list[int]:
    """The grids' masks: segment i belongs to group i modulo ``groups``."""
    return choices([sum(3 << (2 * i) for i in range(g, SEGMENTS, groups)) for g in range(groups)])


BYTE_MASKS = choices([0xFF << (8 * i) for i in range(8)])


def groups_for(points: int) -> int:
    """The fewest groups for which a point meets at most MET random points; 16 groups at most (560 cells a point)."""
    for g in range(5, 16):
        same = 0.375 ** (SEGMENTS * (g - DISTANCE) / g)  # two random pairs of bits have the same popcount in 6 of 16 cases
        if len(list(itertools.combinations(range(g), DISTANCE))) * same * points <= MET:
            return g
    return 16


class _Forest:
    """Union-find; ``add`` tells whether a link joins two components."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def add(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        self.up[max(ra, rb)] = min(ra, rb)
        return ra != rb


def _near(f: np.ndarray, u: np.ndarray, i, j) -> np.ndarray:
    """Which of the pairs are linked: Manhattan distance of the embedding first, then the bits themselves."""
    ok = np.bitwise_count(u[i] ^ u[j]) <= DISTANCE
    ok[ok] = np.bitwise_count((f[i] ^ f[j])[ok] if np.ndim(i) == 0 or np.ndim(j) == 0 else f[i[ok]] ^ f[j[ok]]) <= DISTANCE
    return ok


def linked_in_runs(cell: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
    """Links between points of equal cells (sorted) that span their components; ``f`` unsigned."""
    u, forest, out = embedded(f), _Forest(), []
    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[heads, len(cell)])
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    for d in range(1, min(int(sizes.max()), SHORT_RUN)):
        i = np.flatnonzero((cell[d:] == cell[:-d]) & short[:-d])
        i = i[_near(f, u, i, i + d)]
        out += [(a, b) for a, b in zip(f[i].tolist(), f[i + d].tolist()) if forest.add(a, b)]
    for h, n in zip(heads[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        x, v, label = f[h : h + n], u[h : h + n], np.arange(n)
        for i in range(n - 1):
            for j in i + 1 + np.flatnonzero(_near(x, v, i, slice(i + 1, None)) & (label[i + 1 :] != label[i])):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    if forest.add(int(x[i]), int(x[j])):
                        out.append((int(x[i]), int(x[j])))
    return out


def linked_by_flips(f: np.ndarray) -> list[tuple[int, int]]:
    """The same for one large cell: look up what 1 to 3 flips of the bits that vary give."""
    x = np.sort(f)
    varies = int(np.bitwise_or.reduce(x ^ x[0]))
    bits = [1 << b for b in range(64) if varies >> b & 1]
    forest, label, out = _Forest(), np.arange(len(x)), []
    for k in range(1, DISTANCE + 1):
        for flipped in itertools.combinations(bits, k):
            want = x ^ np.uint64(sum(flipped))
            at = np.minimum(np.searchsorted(x, want), len(x) - 1)
            i = np.flatnonzero((x[at] == want) & (label[at] != label))
            for a, b in zip(i.tolist(), at[i].tolist()):
                if forest.add(a, b):
                    out.append((int(x[a]), int(x[b])))
            if len(i):
                label = np.fromiter((forest.root(r) for r in label.tolist()), dtype=np.int64, count=len(x))
        if not label.any():  # one component
            break
    return out


def _search(points: DataFrame, value: Column, masks: list[int], limit: int, last: bool) -> DataFrame:
    """Links (a, b) between the points (column f) that meet in a cell; rows (a, null) of points in cells over ``limit``, if not ``last``.

    State of a task: the cell that is being read, at most ``limit`` points (2^24 in the last search).
    """
    cells = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.xxhash64(m, value.bitwiseAND(m)))
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = points.select("f", F.explode(cells).alias("cell")).repartition(parts, "cell").sortWithinPartitions("cell")

    def batch_of(a, b=None) -> pa.RecordBatch:
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b], names=["a", "b"])

    def linked(cell, f) -> Iterator[pa.RecordBatch]:
        x = f.view(np.uint64)
        links = linked_by_flips(x) if len(x) > limit and cell[0] == cell[-1] else linked_in_runs(cell, x)
        if links:
            pair = np.array(links, dtype=np.uint64).view(np.int64)
            yield batch_of(pair[:, 0], pair[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cell, open_f, open_n, over = None, [], 0, False  # the cell that is still being read
        for batch in batches:
            f, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            while len(f):
                n = int(np.searchsorted(cell, open_cell, "right")) if open_cell is not None else 0
                if n:
                    open_f.append(f[:n])
                    open_n, f, cell = open_n + n, f[n:], cell[n:]
                    if not last and open_n > limit:
                        over = True
                    if over:
                        yield batch_of(np.concatenate(open_f))
                        open_f = []
                    continue
                if open_f and open_n > 1 and not over:
                    done = np.concatenate(open_f)
                    yield from linked(np.full(len(done), open_cell), done)
                start = int(np.searchsorted(cell, cell[-1], "left"))
                if start:  # whole cells of this batch
                    size = np.diff(np.flatnonzero(np.r_[True, cell[1:start] != cell[: start - 1], True]))
                    small = np.repeat(size <= limit, size)
                    several = small & np.repeat(size > 1, size)
                    if several.any():
                        yield from linked(cell[:start][several], f[:start][several])
                    for h, n in zip((np.cumsum(size) - size)[size > limit], size[size > limit]):
                        yield from linked(cell[h : h + n], f[h : h + n]) if last else [batch_of(f[h : h + n])]
                open_cell, open_f, open_n, over = cell[-1], [f[start:]], len(f) - start, False
                if not last and open_n > limit:
                    over = True
                    yield batch_of(f[start:])
                    open_f = []
                break
        if open_f and open_n > 1 and not over:
            done = np.concatenate(open_f)
            yield from linked(np.full(len(done), open_cell), done)

    return dealt.mapInArrow(run, "a long, b long")


def links(points: DataFrame, groups: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column f) at DISTANCE or fewer bits, enough to span every component."""
    groups = groups or groups_for(points.count())
    found = written(_search(points, embedding(F.col("f")), grid_masks(groups), limit, False), "cell-links")
    crowded = written(found.filter("b IS NULL").select(F.col("a").alias("f")).distinct(), "crowded-points")
    out = found.filter("b IS NOT NULL")
    if crowded.isEmpty():
        return out
    return out.union(written(_search(crowded, F.col("f"), BYTE_MASKS, limit, True), "crowded-links"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", groups: int | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id (smallest key reachable by links).

    Null and empty texts, and texts without words, have the fingerprint zero and are linked like any other. Rows of one
    key are one document: what any of them is linked with is linked. A row without a key links others but is
    no smallest key; a component of such rows only has a null component_id. Other columns are not read or
    returned. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    rows = written(fingerprints(docs, text, key), "simhashes")
    points = written(rows.groupBy("f").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-simhashes")
    versions = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("f").alias("a"), F.max("f").alias("b")).filter("a <> b")
    versions = versions.join(rows.select("id", "f"), "id").filter("f <> a").select("a", F.col("f").alias("b"))
    of = components(links(points.select("f"), groups, limit).union(versions)).withColumnsRenamed({"node": "f", "component": "c"})
    small = written(of.join(points, "f").select("f", "c", "least"), "simhash-components")
    least = small.groupBy("c").agg(F.min("least").alias("component_id"))
    known = points.join(small.select("f", "c").join(least, "c").drop("c"), "f", "left").select("f", "n", F.coalesce("component_id", "least").alias("component_id"))
    known = written(known, "simhash-classes")

    total = rows.count()
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(known.filter(F.col("n") > bound).select("f", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))  # at most HOT_SHARE rows
    marked = rows.join(hot, "f", "left")
    rest = marked.filter("hot IS NULL").select("id", "f").join(known.filter(F.col("n") <= bound).drop("n"), "f")
    out = marked.filter("hot").select("id", "f", F.col("hot_id").alias("component_id")).unionByName(rest)
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
