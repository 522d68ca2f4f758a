"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a broadcast table of the token counts of frequent pre-tokens, bounded by FREQUENT entries
and taken from a bounded sample of rows; it decides speed only. Tier two is a cache in each worker for
the rest: a missing pre-token is encoded once by the library's own model. Pre-tokens never shuffle.

Texts are cut here if their characters are simple, else by the tokenizer's own normalizer and pre-tokenizer;
both ways end in the look-up. Only a text with a special string goes through the library as a whole.
"""
from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, widened

FREQUENT = 32_768
SAMPLE_ROWS = 4_000
#: Entries of a worker's cache; when it is full, it starts again from tier one.
CACHED = 400_000
#: Texts of these characters only are cut into pre-tokens here, if the file's normalizer is the one below;
#: others by the tokenizer's own parts.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ɏ]*")
_NORMALIZERS = ("NFC", "Replace", "Lowercase")

_loaded: dict[str, Tokens] = {}


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level models write bytes: printable ones themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return letters


class Lengths(dict):
    """Pre-token -> number of tokens; a miss asks the model."""

    def __init__(self, frequent: dict[str, int], encode):
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode

    def __missing__(self, token: str) -> int:
        if len(self) > CACHED + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = self[token] = self.encode(token)
        return n


class Tokens:
    """One tokenizer file in one worker: counts tokens of whole texts as the library does."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split = file["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.simple = tuple(n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])) == _NORMALIZERS
        self.special = [t["content"] for t in file["added_tokens"]]
        letters = _byte_letters()
        self.model, self.map = self.library.model, [letters[b] for b in range(256)]
        self.lengths = Lengths({}, self.encode)

    def encode(self, token: str) -> int:
        return len(self.model.tokenize("".join([self.map[b] for b in token.encode()])))

    def use(self, frequent: dict[str, int]) -> None:
        if self.lengths.frequent is not frequent:
            self.lengths = Lengths(frequent, self.encode)

    def cut(self, text: str) -> list[str] | None:
        """Pre-tokens of a text; None if it holds a special string, which the library has to find."""
        if any(special in text for special in self.special):
            return None
        if self.simple and (text.isascii() or _PLAIN.fullmatch(text)) and not _CONTROL.search(text):
            return self.pieces(text.lower())
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        if any(special in normal for special in self.special):
            return None
        return [normal[first:last] for _, (first, last) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        cut = self.cut(text)
        return self.whole(text) if cut is None else sum(map(self.lengths.__getitem__, cut))


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def loaded(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", entries: int = FREQUENT, rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """The most frequent pre-tokens of about ``rows`` sampled texts and their token counts, at most ``entries``."""
    total = docs.count()
    if not total:
        return {}

    def counts(batches):
        tokens, seen = loaded(path), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens.cut(t or "") or ())
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_pydict({"token": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    sample = docs.select(F.col(text).cast("string")).sample(fraction=min(1.0, rows / total), seed=7)
    top = sample.mapInArrow(counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(entries)
    tokens = loaded(path)
    return {r["token"]: tokens.encode(r["token"]) for r in top.collect()}


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) and n_bytes, n_tokens, over_limit of every whole text.

    Null text counts as empty: no bytes, no tokens. Without begin, end or added special tokens; special
    strings inside a text are handled as the library handles them by default. Repeated rows are counted
    each; an empty table gives no rows. Columns of ``docs`` named like a result are replaced.
    """
    spark: SparkSession = docs.sparkSession
    ready(spark)
    results = ("n_bytes", "n_tokens", "over_limit")
    names = [c for c in (docs.columns if keep is None else keep) if c not in results and (keep is not None or c != text)]
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = widened(inner.drop("t").schema, "n_bytes long, n_tokens long")

    def run(batches):
        tokens = loaded(path)
        tokens.use(table.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            n = pa.array([tokens.count(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], size, n], names=schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
