"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 80 % or more.

A partner of a set must share T of its shingles (T follows from the two sizes). DivideSkip finds those
that do: of the inverted lists of the set's shingles the L longest are put aside, the short rest is merged
by a heap, ids that occur T - L times or more are candidates, and these are looked up in the long lists by
binary search. That search runs within parts of bounded size, which Spark prepares:

1. Equal sets are one class, found by a fingerprint; one set per class is joined.
2. Sets that can be linked are connected by shared keys. A key is a pair of neighbours in the sorted set:
   sets of a and b shingles that share o of them share 3 o - a - b - 1 such pairs at least, since each
   shingle of one set alone parts one pair of the shared ones. That is a third of a + b, less one, for
   linked sets; so they share a key among the first keys of each in one global order (prefix filter).
   A passage that many documents hold hardly gives shared pairs, unlike single shingles. Rows of (key,
   set), grouped by key, connect all sets that can be linked. Frequent keys are counted approximately:
   the count decides their place in the order and their salt, not the result.
3. Connected sets form blocks; small blocks share a cell, blocks over LIMIT shingles are cut into chunks
   by a key of each set, and chunks over LIMIT (near copies of one text have that key in common) again by
   the set. The whole sets of a cell are brought together once and searched.
4. For cut blocks: one set of each component found in a chunk is searched against the others of the block,
   which joins groups of copies that lie in many chunks; after that, only prefix rows whose sets are still
   in different components call for more. The sets of such a row meet in the chunk that holds most of
   them; rows of more than LONG_RUN sets, and those of a chunk whose rows hold over LIMIT shingles, are
   dealt over pairs of chunks, so that a part holds two chunks at most.

A frequent key is salted by its count, and all its rows are kept: sets alone with their salt are connected
over the salts. No pair of linked copies is ever a row: links become
components (union-find in a cell, then stars over tables).
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, removed, written

WIDTH = 5
PERCENT = 80
#: Shingles of a part that is searched as a whole.
LIMIT = 500_000
LONG_RUN = 2_000
#: Buckets of the count of frequent shingles in a task, and how many of the largest each task reports.
BUCKETS, REPORTED, FREQUENT = 1 << 20, 4_096, 65_536
#: Sets with one salt of a frequent shingle.
SALTED = 5_000
#: Of meta: above this bit is the salt, and this bit says that the key is salted.
SALT_BIT, SALTED_BIT = 40, 39
MU = 0.0085  # weight of the list length in DivideSkip's choice of L
SMALL_MERGE = 4_096
BROADCAST_IDS = 500_000
CACHED_WORDS = 150_000  # word hashes, and sets seen, that a worker keeps

# Odd multipliers of the five words of a shingle.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    """Word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; fewer than 5 words are one shingle."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, ws), dtype=np.uint64, count=len(ws))
    n = max(len(h) - WIDTH + 1, 1)
    s = np.full(n, min(len(h), WIDTH), dtype=np.uint64)
    for i in range(min(WIDTH, len(h))):
        s += h[i : i + n] * _FACTORS[i]
    s ^= s >> np.uint64(32)
    s *= _FACTORS[3]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def needed(a, b):
    """Shared shingles that link sets of these sizes: 100 * shared >= PERCENT * union."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def search(sets: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components, by DivideSkip over all sets given; ``component`` holds known components.

    Sets that are known to be in one component are not compared; every other pair is.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    comp = component[order].copy()
    everything = np.concatenate([sets[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(order)), sizes)
    by_value = np.argsort(everything, kind="stable")
    values, ids = everything[by_value], owner[by_value]
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[heads, len(values)])
    list_of = np.empty(len(values), dtype=np.int64)
    list_of[by_value] = np.repeat(np.arange(len(heads)), lengths)
    starts = np.cumsum(sizes) - sizes
    links = []
    longest = int(lengths.max()) if len(lengths) else 0
    for q in range(len(order)):
        n = int(sizes[q])
        end = int(np.searchsorted(sizes, n * 100 // PERCENT, "right"))
        if n == 0 or end <= q + 1 or (comp[q + 1 : end] == comp[q]).all():
            continue
        lists = list_of[starts[q] : starts[q] + n]
        lists = lists[lengths[lists] > 1]
        least = needed(n, n)
        if len(lists) < least:
            continue
        lists = lists[np.argsort(lengths[lists], kind="stable")]
        long = min(least - 1, int(least / (MU * np.log2(max(longest, 2)) + 1)))
        short, aside = lists[: len(lists) - long], lists[len(lists) - long :]
        found, count = _merged(ids, heads[short], lengths[short], q, end)
        keep = (count >= least - long) & (comp[found] != comp[q])
        found, count = found[keep], count[keep]
        if not len(found):
            continue
        want = needed(n, sizes[found])
        for k, at in enumerate(aside):  # binary search of the candidates in the long lists, longest last
            one = ids[heads[at] : heads[at] + lengths[at]]
            i = np.searchsorted(one, found)
            count = count + (one[np.minimum(i, len(one) - 1)] == found)
            if k % 16 == 15:  # a candidate that the lists left cannot lift to its need is given up
                hope = count + (len(aside) - k - 1) >= want
                if not hope.all():
                    found, count, want = found[hope], count[hope], want[hope]
                if not len(found):
                    break
        for r in found[count >= want]:
            if comp[r] != comp[q]:
                links.append((int(order[q]), int(order[r])))
                comp[comp == comp[r]] = comp[q]
    return links


def _merged(ids: np.ndarray, heads: np.ndarray, lengths: np.ndarray, after: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids between ``after`` and ``end`` in the given sorted lists, each once, and in how many lists it is."""
    total = int(lengths.sum())
    if total <= SMALL_MERGE:
        out, counts, last = [], [], -1
        for i in heapq.merge(*[ids[h : h + n].tolist() for h, n in zip(heads.tolist(), lengths.tolist(), strict=True)]):
            if i == last:
                counts[-1] += 1
            elif after < i < end:
                out.append(i)
                counts.append(1)
                last = i
        return np.array(out, dtype=np.int64), np.array(counts, dtype=np.int64)
    at = np.repeat(heads - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)  # one long merge: sorted as a whole
    some = np.sort(ids[at])
    return np.unique(some[(some > after) & (some < end)], return_counts=True)


# ---- Spark -----------------------------------------------------------------------------------------


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(texts: DataFrame) -> DataFrame:
    """Rows (id, n, hi, lo) with the fingerprint of each set, and rows (id null, hi = bucket, lo = count) of frequent buckets."""

    def run(batches):
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            ids, n, hi, lo = batch.column("id"), [], [], []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t)
                raw = s.tobytes()
                n.append(len(s))
                hi.append(_signed(xxhash.xxh3_64_intdigest(raw)))
                lo.append(_signed(xxhash.xxh64_intdigest(raw, seed=1)))
                if len(s) > 1:
                    seen[_bucket(keys_of(s))] += 1
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array([False] * len(n), pa.bool_())], names=names)
        top = np.argpartition(seen, -REPORTED)[-REPORTED:]
        top = top[seen[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(top), pa.int64()), pa.array(np.zeros(len(top)), pa.int32()), pa.array(top), pa.array(seen[top]), pa.array([True] * len(top), pa.bool_())], names=names)

    names = ["id", "n", "hi", "lo", "bucket"]
    return texts.mapInArrow(run, "id long, n int, hi long, lo long, bucket boolean")


def keys_of(s: np.ndarray) -> np.ndarray:
    """One hash for each pair of neighbours in a sorted set."""
    k = s[:-1] * _FACTORS[1] + s[1:] * _FACTORS[2]
    k ^= k >> np.uint64(32)
    k *= _FACTORS[3]
    return k ^ (k >> np.uint64(29))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(44)).astype(np.int64)


def prefix_lengths(n: int) -> tuple[int, int]:
    """First keys to look at for a partner that is at least as large, and for any partner."""
    smaller = -(-PERCENT * n // 100)
    return n - -(-2 * n // 3) + 1, n - -(-(n + smaller) // 3) + 1


def prefixes(texts: DataFrame, counts, salted: int = SALTED) -> DataFrame:
    """Rows (h, meta, node) of the key prefix of each distinct set; meta packs salt, whether the key has several
    salts, size, and whether the key is also in the prefix for larger partners (0) or not (1), in this order."""
    names = ["h", "meta", "node"]

    def run(batches):
        frequent = np.zeros(BUCKETS, dtype=np.int64)
        frequent[counts.value[:, 0]] = counts.value[:, 1]
        done: set[int] = set()
        for batch in batches:
            out = [[] for _ in names]
            for t in batch.column("text").to_pylist():
                s = shingle_set(t)
                n = len(s)
                if n < 2:  # a single shingle is linked with an equal set only
                    continue
                node = xxhash.xxh3_64_intdigest(s.tobytes())
                if node in done:  # a copy adds nothing
                    continue
                if len(done) > CACHED_WORDS:
                    done.clear()
                done.add(node)
                k = keys_of(s)
                larger, any_size = prefix_lengths(n)
                seen = frequent[_bucket(k)]
                if len(k) > any_size:
                    order = np.lexsort((k, seen))[:any_size] if seen.any() else np.argsort(k)[:any_size]
                    k, seen = k[order], seen[order]
                else:
                    larger = len(k)
                salts = 1 + seen // salted
                salt = (np.uint64(node) % salts.astype(np.uint64)).astype(np.int64)
                out[0].append(k.view(np.int64))
                out[1].append((salt << SALT_BIT) + ((salts > 1).astype(np.int64) << SALTED_BIT) + 2 * n + (np.arange(len(k)) >= larger))
                out[2].append(np.full(len(k), _signed(node), dtype=np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    return texts.mapInArrow(run, "h long, meta long, node long")


def shared_rows(prefix: DataFrame, parts: int) -> DataFrame:
    """The prefix rows whose shingle more than one set has, with ``prev``: the last earlier set that it may be linked with.

    Of a salted key all rows are kept, since the other sets of the key may have other salts.
    Rows come sorted by key and size; a set can be linked only with one whose ``first`` holds and whose
    size is within the bound, and all those are connected by a chain of ``prev``. State: one row.
    """
    names = ["h", "salt", "node", "n", "prev"]
    dealt = prefix.repartition(parts, "h", F.shiftright("meta", SALT_BIT)).sortWithinPartitions("h", "meta", "node")

    def run(batches):
        carry: list[np.ndarray] | None = None  # the last row, and the last row with ``first`` of its run
        flag = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            old = 0
            if carry is not None:
                old = len(carry[0])
                cols = [np.concatenate([c, x]) for c, x in zip(carry, cols, strict=True)]
            copy = np.zeros(len(cols[0]), dtype=bool)  # the same set from another task
            copy[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] == cols[2][:-1])
            copy[:old] = False
            h, meta, node = cols = [c[~copy] for c in cols]
            salt, n, first = meta >> SALT_BIT, (meta & ((1 << SALTED_BIT) - 1)) >> 1, meta & 1 == 0
            new = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
            at = np.arange(len(h))
            start = np.maximum.accumulate(np.where(new, at, 0))
            last = np.r_[-1, np.maximum.accumulate(np.where(first, at, -1))[:-1]]
            ok = (last >= start) & (100 * n[last] >= PERCENT * n) & (node[last] != node)
            same = np.r_[False, ~new[1:]] | np.r_[~new[1:], False]  # another row of the run is beside it
            emit = same | (meta >> SALTED_BIT & 1 == 1)
            emit[:old] = False
            if carry is not None and not flag and len(h) > old and not new[old]:
                emit[old - 1] = True  # the carried row turned out to have company
            ok[:old] = False
            keep = np.flatnonzero(emit)
            if len(keep):
                prev = pa.array(node[last[keep]], mask=~ok[keep])
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(salt[keep].astype(np.int32)), pa.array(node[keep]), pa.array(n[keep]), prev], names=names)
            tail = [len(h) - 1]
            run_first = last[-1] if not first[-1] else len(h) - 1
            if run_first >= start[-1] and run_first != len(h) - 1:
                tail = [run_first, len(h) - 1]
            flag = bool(emit[-1]) or (len(h) - 1 < old and flag)
            carry = [c[tail] for c in cols]

    return dealt.mapInArrow(run, "h long, salt int, node long, n long, prev long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each connected component, for all nodes of the edges.

    Large-star and small-star rounds; edges are written to the shared folder after each round in place of the last ones,
    so nothing is collected and a lost executor repeats one round at most.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "edges")
        removed(now)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "edges")
        removed(large)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct().toDF("node", "component"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def search_cells(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) found in the parts of ``members`` (id, cell, part, label): whole sets meet by cell and are searched by part."""
    rows = members.count()
    names = ["cell", "part", "id", "label", "s"]
    picked = _few(members.select("id").distinct(), rows)
    wanted = texts.join(picked, "id", "left_semi")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "s"])

    sets = wanted.mapInArrow(run, "id long, s binary").join(_few(members, rows), "id").select(*names)

    def find(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
        raw = table.column("s")
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(part) else []
        a, b = [], []
        for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True):
            rows = order[i:j]
            sets = [np.frombuffer(raw[int(r)].as_py(), dtype=np.uint64) for r in rows]
            for x, y in search(sets, label[rows]):
                a.append(ids[rows[x]])
                b.append(ids[rows[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(sets.groupBy("cell").applyInArrow(find, "a long, b long"), "links")


def _labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``ids`` with the column label: their component under ``links``."""
    found = components(links).withColumnsRenamed({"node": "id", "component": "_c"})
    return ids.join(found, "id", "left").withColumn("label", F.coalesce("_c", "id")).drop("_c")


def join_components(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT, long_run: int = LONG_RUN,
                    salted: int = SALTED) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links), class_id (smallest key with an equal set).

    Texts without words, and null texts, have an empty set and stand alone. Rows of one key are one document
    (linked with all that any of them is linked with). A row without a key gets no component and links nothing.
    An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    ready(spark)
    texts = _texts(docs, text, key)
    made = written(fingerprints(texts), "fingerprints")
    top = made.filter("bucket").groupBy("hi").agg(F.sum("lo").alias("n")).orderBy(F.desc("n"), "hi").limit(FREQUENT).collect()
    counts = spark.sparkContext.broadcast(np.array([(r["hi"], r["n"]) for r in top], dtype=np.int64).reshape(-1, 2))
    rows = made.filter("NOT bucket").drop("bucket")
    classes = rows.filter("n > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("class_id"), F.max("n").alias("n"), F.count("*").alias("rows"))
    classes = written(classes, "classes")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = written(shared_rows(prefixes(texts.filter("id IS NOT NULL"), counts, salted), parts), "shared-prefixes")
    links = _find(texts, shared, classes, limit, long_run)
    removed(shared)

    classed = written(rows.join(classes.drop("n", "rows"), ["hi", "lo"], "left").select("id", F.col("n").cast("long").alias("n"), "class_id"), "classed")
    removed(made, classes)
    again = classed.filter("class_id IS NOT NULL").groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a <> b")
    versions = classed.join(again.select("id", "a"), "id").select("a", F.col("class_id").alias("b")).filter("a <> b")
    final = components(links.union(versions)).withColumnsRenamed({"node": "class_id", "component": "_c"})
    out = classed.join(final, "class_id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("_c", "class_id", "id").alias("component_id"), "class_id")


def _bounded(placed: DataFrame, limit: int) -> DataFrame:
    """``placed`` with chunks of more than ``limit`` shingles dealt by the hash of the set, half full on average."""
    sums = placed.filter("cut").groupBy("part").agg(F.sum("n").alias("_total")).filter(F.col("_total") > limit)
    over = written(sums.select("part", F.ceil(2 * F.col("_total") / limit).alias("_k")), "full-chunks")
    dealt = F.xxhash64("part", F.pmod(F.xxhash64("id", F.lit("chunk")), "_k"))
    return placed.join(over, "part", "left").withColumn("part", F.when(F.col("_k").isNotNull(), dealt).otherwise(F.col("part"))).drop("_k")


def _find(texts: DataFrame, shared: DataFrame, classes: DataFrame, limit: int, long_run: int) -> DataFrame:
    """Links between classes that span all components."""
    edges = shared.filter("prev IS NOT NULL").select(F.col("node").alias("a"), F.col("prev").alias("b"))
    # Salted shingles: their sets are connected over all salts, sizes within the bound by buckets of the size.
    salted = shared.join(shared.filter("salt > 0").select("h").distinct(), "h", "left_semi")
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    centre = salted.withColumn("g", bucket).groupBy("h", "g").agg(F.min("node").alias("c"))
    stars = salted.withColumn("g", bucket).join(centre, ["h", "g"]).select(F.col("node").alias("a"), F.col("c").alias("b"))
    steps = centre.join(centre.select("h", (F.col("g") - 1).alias("g"), F.col("c").alias("d")), ["h", "g"]).select(F.col("c").alias("a"), F.col("d").alias("b"))
    blocks = components(edges.union(stars).union(steps)).withColumnsRenamed({"component": "block"})

    # Sets of a block, by fingerprint; a class is the set of its smallest document.
    of_class = classes.withColumnRenamed("hi", "node").select("node", "class_id", "n")
    sets = written(blocks.join(of_class, "node").select("node", "block", F.col("class_id").alias("id"), F.col("n").cast("long").alias("n")), "block-sets")
    anchor = shared.groupBy("node").agg(F.min("h").alias("anchor"))
    sizes = sets.groupBy("block").agg(F.sum("n").alias("total"))
    cut = F.ceil(F.col("total") / limit)
    chunk = F.when(cut > 1, F.xxhash64("block", F.pmod(F.xxhash64("anchor"), cut))).otherwise(F.col("block"))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    cells = max(1, -(-4 * total // limit))
    chunks = written(sets.join(sizes, "block").join(anchor, "node").select("node", "id", "n", "block", (cut > 1).alias("cut"), chunk.alias("part")), "chunks")
    placed = _bounded(chunks, limit)
    cell = F.when(F.col("cut"), F.col("part")).otherwise(F.pmod(F.xxhash64("block"), F.lit(cells)))
    links = search_cells(texts, placed.select("id", cell.alias("cell"), "part", F.col("id").alias("label")))

    several = written(placed.filter("cut"), "cut-blocks")
    removed(sets, chunks)
    if several.isEmpty():
        return links
    # One set of each component of a chunk, against those of the other chunks of its block.
    labelled = written(_labels(several, links), "labels")
    leaders = labelled.groupBy("block", "part", "label").agg(F.min(F.struct("id", "n")).alias("x")).select("block", "label", "x.id", "x.n")
    width = leaders.groupBy("block").agg(F.ceil(F.sum("n") / limit).alias("k"))
    leaders = leaders.join(width, "block").withColumn("part", F.xxhash64("block", F.pmod(F.xxhash64("id"), "k"), F.lit("leaders")))
    links = links.union(search_cells(texts, leaders.select("id", F.col("part").alias("cell"), "part", "label")))
    labelled = written(_labels(several, links), "labels")

    # Prefix rows whose sets are still in different components.
    runs = shared.select("h", "node").join(labelled.select("node", "id", "n", "part", "label"), "node")
    live = runs.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size")).filter("a <> b").select("h", "size")
    runs = written(runs.join(live, "h"), "live-runs")
    if runs.isEmpty():
        return links
    each = runs.groupBy("h", "part").agg(F.count("*").alias("k"))
    home = each.groupBy("h").agg(F.max(F.struct("k", "part")).alias("x")).select("h", F.col("x.part").alias("home"))
    at_home = runs.filter(F.col("size") <= long_run).join(home, "h")
    crowded = at_home.select("home", "id", "n").distinct().groupBy("home").agg(F.sum("n").alias("total")).filter(F.col("total") > limit).select("home")
    crowded = written(crowded, "crowded-homes")
    short = at_home.join(crowded, "home", "left_anti").select("id", "label", F.xxhash64("home", F.lit("home")).alias("part"))
    dealt = runs.filter(F.col("size") > long_run).select("h").union(home.join(crowded, "home", "left_semi").select("h")).distinct()
    grid = each.join(dealt, "h", "left_semi").select("h", F.col("part").alias("other"))
    wide = runs.join(grid, "h").select("id", "label", F.xxhash64(F.least("part", "other"), F.greatest("part", "other")).alias("part"))
    meet = written(short.union(wide).distinct(), "meetings")
    removed(runs, crowded)
    return links.union(search_cells(texts, meet.select("id", F.col("part").alias("cell"), "part", "label")))
