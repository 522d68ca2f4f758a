"""License scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines, no punctuation, one spelling for
equivalent words, no title before the body of a short licence. Its SHA-256 is looked up among the digests of known licences and notices by a hash
join. Whole documents are looked up, and each line as a text of its own, since notices stand on one line.
"""
from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import LICENSES

COPYRIGHT = r"^[^\p{L}\n]*?(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Words after "copyright" at the start of a line that belong to a sentence and name no holder.
SENTENCE = ("notices? holders? owners? ownership laws? acts? and or licenses? licences? licensed interests? statements? protection "
            "infringement disclaimers? information status claims? material works? treaty treaties rights? patents? trademarks? this that "
            "these in to is are of as for with on you your any all each every such a an if it its no not under which may must shall will permission")
_NO_HOLDER = SENTENCE.replace(" ", "|")
#: A line with a sign, a year or a holder after "copyright", or with the rights reserved alone. The SQL keeps the plain COPYRIGHT.
COPYRIGHT_LINE = (
    r"^[^\p{L}\n]*?(?:©[^\n]*|all rights reserved[^\p{L}\n]*"
    r"|(?:copyright|\(c\))[^\p{L}\n]*(?:©|\(c\)|\d{4}|[<\[{])[^\n]*"
    rf"|copyright[^\p{{L}}\p{{N}}\n]+(?!(?:{_NO_HOLDER})\b)\p{{L}}[^\n]*"
    rf"|\(c\)[^\p{{L}}\p{{N}}\n]+(?!(?:the|{_NO_HOLDER})\b)\p{{L}}[^\n]*)$")
#: Titles in the canonical form, before the first word of the body.
TITLE = (
    r"^(?:the )?(?:mit license(?: mit)?|isc license(?: isc)?|(?:bsd zero clause|zero clause bsd|0bsd)(?: license)?"
    r"|(?:bsd [23] clause|[23] clause bsd)(?: new or revised| new| revised| modified| simplified| freebsd)? license) (?=permission |redistribution )")
#: Spellings and words that count as the same, in the order of their replacement.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("analogue", "analog"), ("judgement", "judgment"), ("whilst", "while"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("https", "http"),
)


def canonical(text: Column) -> Column:
    """The canonical form; empty for null and for a text without letters or digits."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, f"(?md){COPYRIGHT_LINE}", " ")
    t = F.btrim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))
    for old, new in EQUIVALENT:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, TITLE, "")


def full_texts() -> dict[str, str]:
    """The licence files of this package by identifier."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_files").glob("*.txt"))}


def known(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """license_id, digest, size of known texts; of equal texts the first name in order is kept."""
    rows = spark.createDataFrame(list((LICENSES | full_texts() if licenses is None else licenses).items()), "license_id string, text string")
    forms = rows.select("license_id", canonical(F.col("text")).alias("form")).filter("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("size")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, text_digest, license_id (of the whole text, else null), line_licenses (of its lines, in order of name).

    Null texts and texts without letters or digits have neither digest nor licence. Repeated rows of a key
    give one row each, with the lines of all rows of that key; an empty table gives no rows. The sizes of
    known texts prune texts before they are digested.
    """
    sizes = [r["size"] for r in licenses.select("size").distinct().limit(100_000).collect()]
    t = F.col(f"`{text}`").cast("string")
    form = canonical(t)
    whole = docs.select(F.col(f"`{key}`").alias("key"), form.alias("form")).select(
        "key", F.when(F.col("form") != "", F.sha2("form", 256)).alias("text_digest"))
    lines = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.split(t, "\n")).alias("line"))
    lines = lines.select("key", canonical(F.col("line")).alias("form"))
    if len(sizes) < 100_000:
        lines = lines.filter(F.length("form").isin(sizes))
    names = licenses.select("digest", "license_id")
    hits = lines.select("key", F.sha2("form", 256).alias("digest")).join(names, "digest").groupBy("key").agg(
        F.array_sort(F.collect_set("license_id")).alias("line_licenses"))
    found = whole.join(names, whole["text_digest"] == names["digest"], "left").select("key", "text_digest", "license_id")
    h = hits.withColumnRenamed("key", "_k")
    both = found.join(h, found["key"].eqNullSafe(h["_k"]), "left")
    return both.select(F.col("key").alias(key), "text_digest", "license_id",
                       F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
