"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with references of its language by the Jensen-Shannon distance of two
histograms: classes of characters, and the most common words of the language. References are
counted over all documents. Short texts scatter widely, so each test has a minimum length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, let, removed, upto, words, written

#: The classes of characters counted in words.
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{N}",
    "point": r"[.,;:!?\x27\x22()\-]",
    "symbol": r"[#*$%&|<>]",
}
#: One letter per rank of a common word; "." stands for all other words.
RANKS = "abcdefghijklmnopqrstuvwx"
COMMON = len(RANKS)
MIN_CLASS_CHARS = 100
MIN_WORDS = 120
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.31
#: Languages whose references may be broadcast; beyond that they are joined by shuffle.
MAX_BROADCAST_LANGS = 2000


def _count(text: Column, pattern: str) -> Column:
    """Characters of a text that match a pattern of one character."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


def class_counts(chars: Column) -> Column:
    """Characters by class, in the order of CLASSES, then the number of all others, as an array.

    The first class holds most characters; the others are counted in what it leaves.
    """
    first, *rest = CLASSES.values()

    def of_rest(r: Column) -> Column:
        counts = [F.length(chars) - F.length(r), *[_count(r, p) for p in rest]]
        return let(F.array(*[c.cast("long") for c in counts]), lambda a: F.concat(
            a, F.array(F.length(chars).cast("long") - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x))))

    return let(F.regexp_replace(chars, f"{first}+", ""), of_rest)


def repeated_window_words(ws: Column, width: int = 8) -> Column:
    """Words covered by windows of ``width`` words (a power of two) that the text has twice or more.

    Windows are compared by 64-bit hashes. Without a repeated hash nothing is sorted; else windows
    are sorted by hash and position, those beside an equal hash are kept, and their cover is summed.
    """

    def cover(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, of_sorted)

    def of_sorted(s: Column) -> Column:
        m = F.size(s)
        same = lambda j, k: (k >= 0) & (k < m) & (F.get(s, j)["h"] == F.get(s, k)["h"])
        kept = F.filter(upto(0, m - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return let(F.array_sort(F.transform(kept, lambda j: F.get(s, j)["i"])), of_starts)

    def of_starts(p: Column) -> Column:
        steps = F.transform(upto(0, F.size(p) - 2), lambda j: F.least(F.lit(width), F.get(p, j + 1) - F.get(p, j)))
        return F.aggregate(steps, F.lit(width).cast("long"), lambda a, x: a + x)

    def of_windows(windows: Column) -> Column:
        none = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(none, F.lit(0).cast("long")).otherwise(cover(windows))

    def pairs_of(gap: int):
        def of(h: Column) -> Column:
            n = F.greatest(F.size(h) - gap, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b))

        return of

    windows = F.transform(ws, lambda w: F.xxhash64(w))
    gap = 1
    while gap < width:  # hashes of 2, 4, .. words from those of half as many
        windows = let(windows, pairs_of(gap))
        gap *= 2
    return F.when(F.size(ws) < width, F.lit(0).cast("long")).otherwise(let(windows, of_windows))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language, counted over all its documents in one pass and written to the shared folder.

    Words are counted first (partial counts before the shuffle); classes of characters follow from the
    counted words. word_ref holds the COMMON most frequent words in lower case, word_shares their shares
    of all words and the share of the rest.
    """
    ws = docs.filter(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.explode(words(F.col(text).cast("string"))).alias("word"))
    counts = written(ws.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    k = len(CLASSES) + 1
    classed = counts.select("lang", "n", class_counts(F.col("word")).alias("c"))
    sums = classed.groupBy("lang").agg(F.sum("n").alias("all"), *[F.sum(F.get("c", F.lit(i)) * F.col("n")).alias(f"c{i}") for i in range(k)])
    chars = F.greatest(sum(F.col(f"c{i}") for i in range(k)), F.lit(1))
    sums = sums.select("lang", "all", F.array(*[F.col(f"c{i}") / chars for i in range(k)]).alias("class_ref"))
    lower = counts.groupBy("lang", F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    top = lower.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= COMMON)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    common = F.aggregate("top.n", F.lit(0).cast("long"), lambda a, n: a + n)
    refs = written(top.join(sums, "lang").select(
        "lang", "class_ref", F.col("top.word").alias("word_ref"),
        F.concat(F.transform("top.n", lambda n: n / F.col("all")), F.array(F.lit(1.0) - common / F.col("all"))).alias("word_shares"),
    ), "quality-references")
    removed(counts)
    return refs


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares of equal length."""

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def word_histogram(ws: Column, ref: Column) -> Column:
    """Shares of the reference words among ``ws``, then the share of all other words.

    Each word becomes one letter, so that counting a reference word is counting a letter.
    """
    alphabet = F.lit("." + RANKS)

    def shares(letters: Column) -> Column:
        of = lambda a: (F.length(letters) - F.length(F.replace(letters, F.lit(a)))) / F.greatest(F.length(letters), F.lit(1))
        return F.concat(F.slice(F.array(*[of(a) for a in RANKS]), F.lit(1), F.greatest(F.size(ref), F.lit(1))), F.array(of(".")))

    ranks = F.transform(ws, lambda w: F.substring(alphabet, (F.array_position(ref, F.lower(w)) + 1).cast("int"), F.lit(1)))
    return let(F.array_join(ranks, ""), shares)


def judge(docs: DataFrame, refs: DataFrame | None = None, text: str = "text", lang: str = "lang",
          max_class: float = MAX_CLASS_DISTANCE, max_words: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept. Columns of ``docs`` with one of these names are replaced.

    base_failed: under 20 words, or more than 30 % of the words lie in repeated windows. The character
    test needs 100 characters, the word test 120 words; a test below its minimum length, or of a document
    whose language is null or has no reference, passes. Null text counts as no words and fails. Repeated
    rows are judged each on its own; an empty table gives no rows.
    """
    refs = references(docs, text, lang) if refs is None else refs
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    names = [c for c in docs.columns if c not in out]
    r = refs.select(F.col("lang").alias("_ql"), F.struct("class_ref", "word_ref", "word_shares").alias("_qr"))
    df = docs.join(F.broadcast(r) if refs.count() <= MAX_BROADCAST_LANGS else r, F.col(lang) == F.col("_ql"), "left")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def measured(ws: Column) -> Column:
        known = F.col("_ql").isNotNull() & (F.size(ws) >= MIN_WORDS)
        return F.struct(
            F.size(ws).cast("long").alias("words"),
            repeated_window_words(ws).alias("repeat"),
            class_counts(F.concat_ws("", ws)).alias("classes"),
            F.when(known, word_histogram(ws, F.col("_qr.word_ref"))).alias("ranked"))

    # The struct is computed once per row: a projection with several uses of it is not merged into them.
    df = df.withColumn("_q", let(words(t), measured))
    chars = F.aggregate("_q.classes", F.lit(0).cast("long"), lambda a, n: a + n)
    shares = F.transform("_q.classes", lambda n: n / F.greatest(F.col("_qchars"), F.lit(1)))
    df = df.withColumn("_qchars", chars).withColumns({
        "_qdc": F.when(F.col("_ql").isNotNull() & (F.col("_qchars") >= MIN_CLASS_CHARS), js_distance(shares, F.col("_qr.class_ref"))),
        "_qdw": F.when(F.col("_q.ranked").isNotNull(), js_distance(F.col("_q.ranked"), F.col("_qr.word_shares"))),
    })
    base_failed = (F.col("_q.words") < 20) | (100 * F.col("_q.repeat") > 30 * F.col("_q.words"))
    far = (F.coalesce(F.col("_qdc"), F.lit(0.0)) > max_class) | (F.coalesce(F.col("_qdw"), F.lit(0.0)) > max_words)
    return df.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("_q.words").alias("n_words"), F.col("_qchars").alias("word_chars"),
        _count(t, CLASSES["symbol"]).alias("n_symbols"), repeated_lines(t).alias("n_dup_lines"),
        F.col("_q.repeat").alias("n_repeat_words"), base_failed.alias("base_failed"),
        F.col("_qdc").alias("class_distance"), F.col("_qdw").alias("word_distance"), (~base_failed & ~far).alias("kept"))
