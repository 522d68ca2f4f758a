"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Texts are sets of 5-word shingles (words are runs of letters and digits, in lower case). The smallest
hashes of an item's set are a sample of it that any document holding the item has as well, however long
that document is; so a document's hashes are looked up among the items' minima, and a document with
enough of them is a candidate. Items are partitioned by size: each class has its own number of minima and
its own bound, the largest minimum of its items, above which a document's hash is not looked up. All
candidates are then checked by exact containment of the shingles themselves.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, upto, written

SHINGLE = 5
THRESHOLD = 80  # percent of the item's shingles
#: Minima of an item, by the least size of its class: (shingles from, minima).
CLASSES = ((1, 16), (64, 20), (512, 24), (4096, 32))
#: Tables of at most so many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000


def letters_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed_shingles(ws: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of all windows of 5 words; fewer words are one shingle; none without words."""
    assert width == 5

    def joined(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def from_(h: Column, start: int, n: Column) -> Column:
        return F.slice(h, F.lit(start + 1), F.greatest(n, F.lit(0)))

    def of(h: Column) -> Column:
        n = F.size(h)
        two = let(joined(from_(h, 0, n - 1), from_(h, 1, n - 1)), lambda p: joined(from_(p, 0, F.size(p) - 2), from_(p, 2, F.size(p) - 2)))
        five = let(two, lambda f: joined(from_(f, 0, F.size(f) - 1), from_(h, 4, n - 4)))
        return F.when(n >= width, five).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def shingles(ws: Column, width: int = SHINGLE) -> Column:
    """The distinct shingles themselves."""
    return let(ws, lambda w: F.when(
        F.size(w) >= width, F.array_distinct(F.transform(upto(1, F.size(w) - width + 1), lambda i: F.concat_ws(" ", F.slice(w, i, width)))),
    ).when(F.size(w) > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>")))


def _of_class(size: Column, at: int) -> Column:
    return reduce(lambda c, k: c.when(size >= k[0], k[at]), reversed(CLASSES[:-1]), F.when(size >= CLASSES[-1][0], CLASSES[-1][at]))


def signatures(items: DataFrame, text: str = "text", key: str = "item_id", threshold: int = THRESHOLD) -> DataFrame:
    """One row per item and minimum: item, item_class, size, h, need (minima that make a candidate).

    A set no larger than its number of minima is known whole, and needs the threshold itself. Else a
    quarter of the minima: a set that is contained by 80 % has fewer with a chance below 3 in a million.
    """
    sets = items.filter(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.array_distinct(hashed_shingles(letters_words(F.col(text)))).alias("s"))
    size = F.size("s")
    sized = sets.filter(size > 0).select("item", size.alias("size"), _of_class(size, 0).alias("item_class"), _of_class(size, 1).alias("m"), F.array_sort("s").alias("s"))
    need = F.when(F.col("size") <= F.col("m"), F.ceil(F.col("size") * threshold / 100)).otherwise(F.ceil(F.col("m") / 4)).cast("int")
    return sized.select("item", "item_class", "size", need.alias("need"), F.explode(F.slice("s", F.lit(1), F.col("m"))).alias("h"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is short."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def candidates(docs: DataFrame, sigs: DataFrame, text: str = "text") -> DataFrame:
    """key, digest, item for documents with enough of an item's minima."""
    bounds = {r["item_class"]: r["b"] for r in sigs.groupBy("item_class").agg(F.max("h").alias("b")).collect()}
    hashes = docs.select("key", "digest", F.explode(hashed_shingles(letters_words(F.col(text)))).alias("h"))
    hashes = hashes.filter(F.col("h") <= F.lit(max(bounds.values(), default=-(2**63))))
    within = reduce(lambda c, k: c.when(F.col("item_class") == k[0], F.col("h") <= F.lit(k[1])), bounds.items(), F.when(F.lit(False), F.lit(False)))
    hits = hashes.join(_small(sigs), "h").filter(within)
    found = hits.groupBy("key", "digest", "item", "need").agg(F.size(F.collect_set("h")).alias("n"))
    return found.filter(F.col("n") >= F.col("need")).select("key", "digest", "item")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item whose shingles it holds by ``threshold`` percent or more.

    Columns: key, item_key, n_shared, n_item, and digest (of the text, to tell rows of one key apart).
    Null and empty texts match nothing; items without an id are left out; repeated documents give one pair;
    empty tables give no rows.
    """
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    d = d.withColumn("digest", F.xxhash64("text"))
    i = items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sigs = written(signatures(i, threshold=threshold), "item-minima")
    found = written(candidates(d, sigs), "decontamination-candidates").withColumnsRenamed({"key": "_k", "digest": "_d"})
    texts = d.join(_small(found), F.col("key").eqNullSafe(F.col("_k")) & (F.col("digest") == F.col("_d"))).drop("_k", "_d").dropDuplicates(["key", "digest", "item"])
    sets = i.filter("item_id IS NOT NULL").dropDuplicates(["item_id"]).select(F.col("item_id").alias("item"), shingles(letters_words(F.col("text"))).alias("q"))
    exact = texts.join(sets, "item").select("key", "digest", "item", "q", shingles(letters_words(F.col("text"))).alias("s"))
    counted = exact.select("key", "digest", "item", F.size(F.array_intersect("q", "s")).cast("long").alias("n_shared"), F.size("q").cast("long").alias("n_item"))
    return counted.filter(100 * F.col("n_shared") >= threshold * F.col("n_item")).select(
        F.col("key").alias(key), F.col("item").alias(item_key), "n_shared", "n_item", "digest")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    hit = written(contaminated(docs, items, text, key).select(F.col(key).alias("_k"), F.col("digest").alias("_d")).distinct(), "contaminated")
    mark = F.col(f"docs.`{key}`").eqNullSafe(F.col("hit._k")) & (F.xxhash64(F.col(f"docs.`{text}`").cast("string")) == F.col("hit._d"))
    return docs.alias("docs").join(_small(hit).alias("hit"), mark, "left_anti")
