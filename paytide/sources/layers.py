"""Readers and writers of the Silver, Gold, dataset and prediction layers."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.parsing import strip
from ..operators.silver import ENTITY
from ..session import ensure_checkpoint_dir, shuffles_go

# Folder of each Gold table.
GOLD_FOLDERS = {"realized": "realized_cash_in", "known": "known_movements_daily"}
_DATES = ("DATE", "TRADE_DATE", "VALUE_DATE")
_NUMBERS = ("TARGET_AMOUNT", "KNOWN_AMOUNT", "KNOWN_COUNT", "OBSERVATION_COUNT", "SIGNED_AMOUNT",
            "AMOUNT", "SIGN")
_TEXTS = (ENTITY, "CURRENCY_SHORTNAME", "MOVEMENT_SCOPE", "CASH_MOVEMENT_TYPE_SHORTNAME")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Layers:
    """Derived tables of one run: each is written once to the shared folder and read back with its schema.

    A later step reads files in place of replanning all that lies before it, so plans stay small however
    often a table is used, and a lost executor repeats one step at most. A layer is written when it is
    first asked for, and its shuffle files go with that; ``drop`` removes layers that only later ones read, ``clear``
    all of them.
    """

    def __init__(self, spark: SparkSession, name: str = "layers"):
        self.spark, self.name, self.path = spark, name, None
        self._schemas: dict[str, StructType] = {}

    def get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._schemas:
            self.path = self.path or scratch_path(self.spark, self.name)
            with shuffles_go(self.spark):
                df = build()
                df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
            self._schemas[name] = df.schema
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove layers that no table in use reads; they are built again if asked for."""
        for name in names:
            if self._schemas.pop(name, None) is not None:
                remove(self.spark, f"{self.path}/{name}")

    def clear(self) -> None:
        if self.path:
            remove(self.spark, self.path)
            self.path, self._schemas = None, {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_silver(silver: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """One dataset, partitioned by entity; a large entity is spread over several files."""
    silver.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(ENTITY).parquet(
        f"{path}/movements"
    )


def write_reports(path: str, **reports: DataFrame) -> None:
    for name, report in reports.items():
        report.write.mode("overwrite").json(f"{path}/_reports/{name}")


def read_silver(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    silver = spark.read.parquet(f"{path}/movements")
    return silver if entity is None else silver.filter(F.col(ENTITY) == entity)


def write_gold(gold: dict[str, DataFrame], path: str) -> None:
    for name, df in gold.items():
        df.write.mode("overwrite").parquet(f"{path}/{GOLD_FOLDERS[name]}")


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{folder}") for name, folder in GOLD_FOLDERS.items()}


def normalize_table(df: DataFrame) -> DataFrame:
    """Dates cut to the day, known numbers as double, keys as text; bad values become null."""

    def fix(name, kind):
        c = F.col(name)
        if name in _DATES:
            return (F.try_to_timestamp(c).cast("date") if kind == "string" else c.cast("date")).alias(name)
        if name in _NUMBERS:
            return (strip(c) if kind == "string" else c).try_cast("double").alias(name)
        if name in _TEXTS:
            return c.cast("string").alias(name)
        return c

    return df.select(*[fix(name, kind) for name, kind in df.dtypes])


def load_gold_normalized(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: normalize_table(df) for name, df in read_gold(spark, path).items()}


def load_silver_normalized(spark: SparkSession, path: str) -> DataFrame:
    return normalize_table(read_silver(spark, path))


def write_dataset(dataset: DataFrame, path: str) -> None:
    monthly = dataset.withColumn("CUTOFF_MONTH", F.date_format("CUTOFF_DATE", "yyyy-MM"))
    monthly.write.mode("overwrite").partitionBy("CUTOFF_MONTH").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Only the runs present in the input are replaced."""
    (
        predictions.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("MODEL_NAME", "CUSTOM_NAME")
        .parquet(path)
    )


def write_forecast(forecasts: DataFrame, path: str) -> None:
    (
        forecasts.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("CUTOFF_DATE")
        .parquet(path)
    )


def scan_prediction_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every prediction file below a folder, the run named by its folder relative to it."""
    base = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
        .withColumn("_path", F.url_decode(F.col("_metadata.file_path")))
    )
    folder = F.regexp_replace("_path", r"/[^/]*$", "")
    run = F.substr(F.col("_folder"), F.locate(base, F.col("_folder")) + len(base) + 1)
    return files.withColumn("_folder", folder).withColumn("RUN_NAME", run).drop("_path", "_folder")


def write_series_outputs(path: str, long: DataFrame, wide: DataFrame, assigned: DataFrame | None = None, **tables: DataFrame) -> None:
    """Daily series long and assigned rows as parquet, daily series wide as CSV, the other tables as zipped CSV.

    The shuffle files of each go before the next.
    """
    with shuffles_go(long.sparkSession):
        long.write.mode("overwrite").parquet(f"{path}/series_daily_long")
        wide.write.mode("overwrite").option("header", True).csv(f"{path}/series_daily_wide")
        if assigned is not None:
            assigned.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/assigned_transactions")
        for name, df in tables.items():
            df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/{name}")
