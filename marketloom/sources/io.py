"""Readers, writers and the versioned feature layout."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.functions.shared import shared_folder

PARQUET_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint directory."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).csv(path)


def load_all(spark: SparkSession, path: str, tables: tuple[str, ...] = PARQUET_TABLES) -> dict[str, DataFrame]:
    """Register every table of a directory as a temporary view."""
    loaded = {}
    for table in tables:
        loaded[table] = spark.read.parquet(f"{path}/{table}.parquet")
        loaded[table].createOrReplaceTempView(table)
    return loaded


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by its join keys.

    Orders, lines and returns bucketed alike by ``order_id`` join and aggregate on
    it without a shuffle; choose ``buckets`` so that one bucket fits a task.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 10_000, **properties: str) -> None:
    """Append or replace a database table in batches; every partition writes on its own connection."""
    df.write.mode(mode).option("batchsize", batch_size).jdbc(url, table, properties=properties)


def run_jobs(jobs: Mapping[str, Callable[[], DataFrame]], base: str, partition_by: Mapping[str, tuple[str, ...]] | None = None) -> list[str]:
    """Write one parquet result per job; a job whose input path or table is missing is skipped, any other error is raised."""
    written = []
    for name, job in jobs.items():
        try:
            df = job()
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
            continue
        write_table(df, f"{base}/{name}", partition_by=(partition_by or {}).get(name, ()))
        written.append(name)
    return written


def write_feature(df: DataFrame, base: str, feature: str, version: int) -> str:
    """Feature rows under ``base/feature/version=N`` so a version is a partition filter."""
    path = f"{base}/{feature}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_feature(spark: SparkSession, base: str, feature: str, version: int | None = None) -> DataFrame:
    """One version of a feature, the newest unless named."""
    rows = spark.read.parquet(f"{base}/{feature}")
    if version is None:
        return rows.filter(F.col("version") == rows.agg(F.max("version")).scalar())
    return rows.filter(F.col("version") == version)
