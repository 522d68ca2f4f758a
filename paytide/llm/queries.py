"""The registered queries of this package, one per operator, and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sql import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import build, judge, known_rules

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), build(known_rules(spark))).drop("url")


@_query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, archived_pages

    return archived_pages(spark, archive(table(spark, sf_dir, "pages")))


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "held_out", "text"), learn(docs.filter(~F.col("held_out"))))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")


@_query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import known, scan

    return scan(table(spark, sf_dir, "documents"), known(spark))


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


@_query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join_components

    return join_components(table(spark, sf_dir, "documents"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]
