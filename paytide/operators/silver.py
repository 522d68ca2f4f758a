"""Raw text tables to typed, flagged movement rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import PARSERS, any_of, clean_text, normalize_columns
from ..schema import SPARK_TYPES, TableShape, movement_shape

# Lineage and flag columns added to every row.
LINEAGE_SOURCE = "_lineage_source_name"
LINEAGE_ROW = "_lineage_source_row_number"
MISSING_REQUIRED = "_quality_missing_required_fields"
DUPLICATE_ID = "_quality_duplicate_id"
REVERSED_DATES = "_anomaly_value_date_before_trade_date"
SIGNED_MISMATCH = "_anomaly_signed_amount_mismatch"

# Names of the report counters and the flags they count.
REPORT_COUNTERS = (
    ("missing_required_rows", MISSING_REQUIRED),
    ("duplicate_id_rows", DUPLICATE_ID),
    ("value_before_trade_rows", REVERSED_DATES),
    ("signed_amount_mismatch_rows", SIGNED_MISMATCH),
)

ENTITY = "ENTITY_SHORTNAME"


def conform_schema(raw: DataFrame, shape: TableShape | None = None) -> DataFrame:
    """Typed columns of the shape first, other columns behind them unchanged."""
    shape = shape or movement_shape()
    raw = normalize_headers(raw)
    shape.check(raw.columns)
    present = set(raw.columns)
    typed = [
        (PARSERS[f.kind](f.name) if f.name in present else F.lit(None).cast(SPARK_TYPES[f.kind])).alias(
            f.name
        )
        for f in shape.fields
    ]
    extras = [F.col(c) for c in raw.columns if c not in shape.names]
    return raw.select(*typed, *extras)


def normalize_headers(raw: DataFrame) -> DataFrame:
    """Upper-case headers, but leave our own lineage columns as they are."""
    lineage = {c.upper(): c for c in (LINEAGE_SOURCE, LINEAGE_ROW)}
    upper = normalize_columns(raw)
    return upper.toDF(*[lineage.get(c, c) for c in upper.columns])


def parse_issue_counts(raw: DataFrame, shape: TableShape | None = None, by: str | None = None) -> DataFrame:
    """Rows per column whose text is present but could not be parsed: one pass over the raw table."""
    shape = shape or movement_shape()
    raw = normalize_headers(raw)
    shape.check(raw.columns)
    columns = [f for f in shape.fields if f.name in raw.columns]
    counters = [
        F.count_if(clean_text(f.name).isNotNull() & PARSERS[f.kind](f.name).isNull()).alias(f.name)
        for f in columns
    ]
    keys = [by] if by else []
    wide = raw.groupBy(*keys).agg(*counters)
    long = wide.unpivot(keys, [f.name for f in columns], "column_name", "issue_count")
    return long.filter("issue_count > 0").withColumn("issue_type", F.lit("parse_error"))


def missing_required(shape: TableShape | None = None) -> Column:
    return any_of(F.col(c).isNull() for c in (shape or movement_shape()).required)


def reversed_dates() -> Column:
    return F.coalesce(F.col("VALUE_DATE") < F.col("TRADE_DATE"), F.lit(False))


def signed_mismatch(tolerance: float = 0.01) -> Column:
    expected = F.col("AMOUNT") * F.col("SIGN").cast("double")
    return F.coalesce(F.abs(F.col("SIGNED_AMOUNT") - expected) > tolerance, F.lit(False))


def flag_duplicate_ids(df: DataFrame, keys=(ENTITY, "ID"), flag: str = DUPLICATE_ID) -> DataFrame:
    """Mark every row of a repeated key, nulls being equal.

    Keys are counted with map-side combine and only the repeated ones are joined back, so a key
    that holds a large part of all rows never has to sit in one window partition; the join side
    with the rows can be split by adaptive skew handling.
    """
    repeated = df.groupBy(*keys).count().filter("count > 1").drop("count")
    marked = repeated.select(*[F.col(k).alias(f"_dup_{k}") for k in keys], F.lit(True).alias("_dup"))
    on = [F.col(k).eqNullSafe(F.col(f"_dup_{k}")) for k in keys]
    joined = df.drop(flag).join(marked, on, "left")
    return joined.withColumn(flag, F.coalesce("_dup", F.lit(False))).drop(*marked.columns)


def quality_flags(df: DataFrame, shape: TableShape | None = None) -> DataFrame:
    """Row flags that need no other row."""
    return df.withColumns(
        {
            MISSING_REQUIRED: missing_required(shape),
            REVERSED_DATES: reversed_dates(),
            SIGNED_MISMATCH: signed_mismatch(),
        }
    )


def silver_build(raw: DataFrame, shape: TableShape | None = None) -> DataFrame:
    """Typed and flagged rows of all sources in one table (partition it by entity when writing)."""
    return flag_duplicate_ids(quality_flags(conform_schema(raw, shape), shape))


def clustered_by_entity(silver: DataFrame) -> DataFrame:
    """Rows of an entity in TRADE, VALUE, ID order, nulls last.

    Range partitioning on the full sort key spreads a large entity over several tasks, where
    hashing on the entity alone would put it into one.
    """
    order = [F.col(ENTITY).asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in ("TRADE_DATE", "VALUE_DATE", "ID")
    ]
    return silver.repartitionByRange(*order).sortWithinPartitions(*order)


def _flag_counts():
    return [F.count_if(F.col(flag)).alias(name) for name, flag in REPORT_COUNTERS]


def silver_source_report(silver: DataFrame) -> DataFrame:
    counts = [c for c, (name, _) in zip(_flag_counts(), REPORT_COUNTERS) if name != "duplicate_id_rows"]
    return silver.groupBy(F.col(LINEAGE_SOURCE).alias("table_name")).agg(
        F.count("*").alias("row_count"), *counts
    )


def silver_entity_report(silver: DataFrame) -> DataFrame:
    return silver.groupBy(F.coalesce(ENTITY, F.lit("UNKNOWN")).alias("entity")).agg(
        F.count("*").alias("row_count"), *_flag_counts()
    )


def build_manifest(layer: str, **tables: DataFrame) -> DataFrame:
    """One row per table: layer, name, rows."""
    rows = [
        t.agg(F.count("*").alias("row_count")).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "row_count"
        )
        for name, t in tables.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def drop_id_duplicates(df: DataFrame, key: str = "ID", order=("TRADE_DATE", "VALUE_DATE", "AMOUNT")) -> DataFrame:
    """First row per ID in a stated order (file order means nothing on a cluster).

    The least struct combines on the map side, so repeated IDs shrink before the shuffle, and every column
    is sorted and shuffled once.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(key).agg(first.alias("_row")).select(key, *[F.col(f"_row.{c}") for c in rest])
