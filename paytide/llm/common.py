"""Small helpers shared by the operators of this package."""
from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, shuffles_go

#: The white space that separates words.
BLANKS = r"[\x20\x09-\x0D]+"
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Before Python runs on executors: give them this package, and texts in small batches.

    Whole texts go to Python in batches of at most ARROW_ROWS rows, so that long texts fit in memory.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))  # Spark's own file service hands it to every executor
        _shipped.add(context.applicationId)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the store that driver and executors share (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back; the shuffle files go with that."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_go(spark):
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def widened(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with more columns (StructType.add would change the one of the DataFrame)."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def words(text: Column) -> Column:
    """All words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row (a lambda would compute it once per element)."""
    return F.transform(F.array(value), body)[0]


def upto(first: int, last: Column) -> Column:
    """first..last as an array, empty when last < first."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
