"""Readers for the input tables (one Parquet dataset per table).

Each reader selects only the columns the caller names, so the Parquet scan gets a
pruned ``ReadSchema``; filters placed on the returned DataFrame are pushed into
the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one input table, optionally projecting ``columns``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_positioned(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with ``position``, the place of each row in its input (file, then row in the file).

    It comes with the scan and is a value of the row: filters, splits, unions and shuffles keep it, and ordering by it
    at the end restores the input order without a global window."""
    df = read_table(spark, sf_dir, name)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*(columns or df.columns), place.alias("position"))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core before CPU-heavy per-row work.

    A small table stored as one Parquet row group is scanned by a single task; the
    round-robin repartition only happens then (partitions < default parallelism), so
    large inputs - already split into many more partitions than cores - pass through
    without an extra shuffle.  The count comes from the file listing (no job runs).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).lineitem`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def read(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, *columns)
