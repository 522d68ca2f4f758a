"""Raw text extracts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.silver import LINEAGE_ROW, LINEAGE_SOURCE


def read_bronze(spark: SparkSession, path: str, separator: str = ";", same_header: bool = False) -> DataFrame:
    """All ``*.csv`` below a folder (or one file) as text, with file name and row number.

    Files may differ in their headers: one scan per distinct header layout, united by name.
    ``same_header`` skips the look at the header lines, which reads the texts once more.
    """
    if same_header:
        return _read_layout(spark, path, separator)
    # Only header lines reach the driver: the first line of every file, one per file.
    layouts: dict[str, list[str]] = {}
    heads = (
        spark.read.option("pathGlobFilter", "*.csv")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        .filter("at = 0")
        .withColumn("_i", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("value", "_i").alias("header"))
    )
    for row in heads.toLocalIterator():
        layouts.setdefault(row["header"], []).append(row["file"])
    out = None
    for header, files in sorted(layouts.items()):
        part = _read_layout(spark, files, separator)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no csv files below {path}")
    return out


def _read_layout(spark: SparkSession, files, separator: str) -> DataFrame:
    raw = spark.read.csv(
        files, sep=separator, header=True, inferSchema=False, nullValue="\u0000", emptyValue="",
        pathGlobFilter="*.csv",
    )
    names = raw.columns
    raw = raw.fillna("", names)  # a blank field is an empty text here; Silver decides what is missing
    return number_rows(
        raw.select(
            *names,
            F.col("_metadata.file_name").alias(LINEAGE_SOURCE),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def number_rows(raw: DataFrame) -> DataFrame:
    """1-based row number per file without putting a file into one task.

    Rows are numbered inside their input split, whose size is bounded; splits get their offset
    from a running sum over the few (file, split) counts.
    """
    numbered = raw.withColumn("_i", F.monotonically_increasing_id())
    in_block = Window.partitionBy("_file", "_block").orderBy("_i")
    blocks = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = numbered.withColumn("_r", F.row_number().over(in_block))
    return (
        local.join(offsets, ["_file", "_block"])
        .withColumn(LINEAGE_ROW, F.col("_r") + F.col("_off"))
        .drop("_file", "_block", "_i", "_r", "_off")
    )


def read_extract_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated extract of cleaned movements, header blanks removed, all columns text."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.toDF(*[c.strip() for c in raw.columns])
