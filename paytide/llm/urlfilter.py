"""URL filters by a sorted digest array.

Rules are texts "host/path". Their 64-bit xxhash keys are kept sorted in segment files, beside the full
texts. Workers map the segments into memory, probe all hosts and path prefixes of a batch of URLs by a
vectorised binary search, and confirm each hit against the stored text.
"""
from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, shared_path
from .files import mapped, put

#: The rules of the registered query, as (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Verdict for a URL that no rule fits.
OTHERWISE = "allow"
RULES_PER_SEGMENT = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_open: dict[str, Segment] = {}


def host(url: Column) -> Column:
    """After the first "://" up to /, ?, # or the end, A-Z in lower case; empty for null or without "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Segment:
    """A sorted run of keys with their texts and verdicts, mapped into memory."""

    def __init__(self, file: str):
        raw = np.memmap(file, dtype=np.uint8, mode="r")
        (n,) = struct.unpack("<Q", raw[:8].tobytes())
        at = 8
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.ends = raw[at + 8 * n : at + 16 * n].view(np.uint64)
        self.verdicts = raw[at + 16 * n : at + 17 * n]
        self.texts = raw[at + 17 * n :]

    def text(self, i: int) -> bytes:
        start = int(self.ends[i - 1]) if i else 0
        return self.texts[start : int(self.ends[i])].tobytes()


def _packed(rules: list[tuple[int, bytes, int]]) -> bytes:
    rules = sorted(rules)
    n = len(rules)
    ends = np.cumsum([len(t) for _, t, _ in rules], dtype=np.uint64) if n else np.zeros(0, np.uint64)
    head = struct.pack("<Q", n)
    keys = np.array([k for k, _, _ in rules], dtype=np.uint64)
    return head + keys.tobytes() + ends.tobytes() + bytes(v for _, _, v in rules) + b"".join(t for _, t, _ in rules)


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def build(rules: DataFrame, folder: str | None = None, rows_per_segment: int = RULES_PER_SEGMENT) -> dict:
    """Write the digest array of ``rules`` (rule string "host/path", verdict "allow" or "block").

    A rule given twice blocks if one of its rows blocks; null rules are left out; A-Z of the host count as
    lower case. Spark sorts by key over segments; the driver gets one line per segment and the distinct
    lengths of rule paths (bounded by the longest path).
    """
    spark: SparkSession = rules.sparkSession
    folder = folder or shared_path(spark, "digests")
    text = F.col("rule").cast("string")
    slash = F.instr(text, "/")
    lower = F.when(slash > 0, F.concat(F.translate(F.substring(text, F.lit(1), slash - 1), _UPPER, _LOWER), F.substring(text, slash, F.length(text)))
                   ).otherwise(F.translate(text, _UPPER, _LOWER))
    clean = rules.filter(text.isNotNull()).groupBy(lower.alias("rule")).agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"))

    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:  # big-endian bytes sort as unsigned numbers
        return texts.map(lambda t: struct.pack(">Q", _key(t.encode())))

    keyed = clean.select("rule", "block", key("rule").alias("key"), F.greatest(F.length("rule") - F.instr("rule", "/") + 1, F.lit(0)).alias("tail"), F.instr("rule", "/").alias("slash"))
    keyed = keyed.withColumn("tail", F.when(F.col("slash") > 0, F.col("tail")).otherwise(0))
    n = keyed.count()
    tails = sorted(r["tail"] for r in keyed.select("tail").distinct().collect())
    dealt = keyed.repartitionByRange(max(1, -(-n // rows_per_segment)), "key")

    def write(frames):
        from pyspark import TaskContext

        got = [(struct.unpack(">Q", k)[0], r.encode(), int(b)) for f in frames for k, r, b in zip(f["key"], f["rule"], f["block"], strict=True)]
        if got:
            name = f"{folder}/segment-{TaskContext.get().partitionId():06d}.bin"
            put(name, _packed(got))
            yield pd.DataFrame({"first": [struct.pack(">Q", min(got)[0])], "file": [name]})

    made = dealt.mapInPandas(write, "first binary, file string").collect()
    made = sorted((bytes(r["first"]), r["file"]) for r in made)
    return {"first": [struct.unpack(">Q", k)[0] for k, _ in made], "files": [f for _, f in made], "tails": tails}


def _segment(uri: str) -> Segment:
    if uri not in _open:
        _open[uri] = Segment(mapped(uri))
    return _open[uri]


def _candidates(h: str, p: str, tails: list[int]):
    """All texts that a fitting rule can have: the host and its parent domains, with each prefix length of a rule."""
    parts = h.split(".")
    for d in range(len(parts)):
        domain = ".".join(parts[d:])
        for n in tails:
            if n <= len(p):
                yield domain + p[:n]


def probe(hosts: list[str], paths: list[str], digests: dict) -> tuple[list[str | None], list[int]]:
    """The longest fitting rule of each URL and whether it blocks (-1: no rule)."""
    owner, texts = [], []
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        for c in _candidates(h, p, digests["tails"]) if h else ():
            owner.append(i)
            texts.append(c.encode())
    found: list[str | None] = [None] * len(hosts)
    verdict = [-1] * len(hosts)
    if not texts or not digests["files"]:
        return found, verdict
    keys = np.fromiter((_key(t) for t in texts), dtype=np.uint64, count=len(texts))
    firsts = np.array(digests["first"], dtype=np.uint64)
    # Equal keys may lie on both sides of a segment's start: look in the segment before as well.
    last = np.searchsorted(firsts, keys, "right") - 1
    before = np.searchsorted(firsts, keys, "left") - 1
    for s, uri in enumerate(digests["files"]):
        mine = np.flatnonzero((last == s) | (before == s))
        if not len(mine):
            continue
        seg = _segment(uri)
        lo = np.searchsorted(seg.keys, keys[mine], "left")
        hi = np.searchsorted(seg.keys, keys[mine], "right")
        for j, a, b in zip(mine[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
            for k in range(a, b):
                if seg.text(k) == texts[j]:
                    rule, i = texts[j].decode(), owner[j]
                    if found[i] is None or len(rule) > len(found[i]):
                        found[i], verdict[i] = rule, int(seg.verdicts[k])
    return found, verdict


def judge(pages: DataFrame, digests: dict, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """The columns of ``pages`` and host, path, rule, verdict (columns with these names are replaced).

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest wins,
    of two equally long ones that with the longer host.
    Without a fitting rule, and for a null URL or one without "://", rule is null and verdict ``otherwise``.
    Repeated rows are judged each; an empty table gives no rows.
    """
    ready(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    link = F.col(f"`{url}`").cast("string")
    df = pages.select(*[F.col(f"`{c}`") for c in names], host(link).alias("host"), path(link).alias("path"))

    @F.pandas_udf("rule string, block int")
    def look(h: pd.Series, p: pd.Series) -> pd.DataFrame:
        rule, block = probe(h.tolist(), p.tolist(), digests)
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "block": block})

    hit = df.withColumn("_hit", look("host", "path"))
    verdict = F.when(F.col("_hit.block") == 1, "block").when(F.col("_hit.block") == 0, "allow").otherwise(otherwise)
    return hit.select(*[F.col(f"`{c}`") for c in names], "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"))


def known_rules(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")
