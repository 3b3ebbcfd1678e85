"""Fitted parameters as versioned tables, with a pointer to the latest version.

Tables lie under ``tables/<kind>/<dataset>/<version>``.  A version counts once its pointer entry is there: one small file that
the file system puts in place as a whole after all tables of the version are written, so readers see the version before or
the new one, never a part.  A pointer entry carries a sequence number; the greatest is the latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "dataset string, version string, seq long, kinds array<string>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its own file system; errors of access are raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class ArtifactStore:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _pointers(self, dataset: str) -> DataFrame:
        if not path_exists(self.spark, f"{self.base}/pointers/{dataset}"):
            return self.spark.createDataFrame([], _POINTER)
        return self.spark.read.schema(_POINTER).parquet(f"{self.base}/pointers/{dataset}")

    def save(self, dataset: str, version: str, tables: dict[str, DataFrame]) -> None:
        """Write all ``tables`` of a version and make it the latest; a saved version may be saved again."""
        for kind, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.base}/tables/{kind}/{dataset}/{version}")
        seq = (self._pointers(dataset).agg(F.max("seq")).first()[0] or 0) + 1
        entry = self.spark.createDataFrame([(dataset, version, seq, sorted(tables))], _POINTER)
        entry.coalesce(1).write.mode("append").parquet(f"{self.base}/pointers/{dataset}")

    def versions(self, dataset: str) -> list[str]:
        """The versions of a data set, the latest first."""
        latest = self._pointers(dataset).groupBy("version").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"))
        return [r["version"] for r in latest.collect()]

    def load(self, dataset: str, kind: str, version: str | None = None) -> DataFrame | None:
        """The table of a version, by default the latest; None if there is none."""
        known = self._pointers(dataset).filter(F.array_contains("kinds", kind))
        if version is not None:
            known = known.filter(F.col("version") == version)
        last = known.orderBy(F.desc("seq")).first()
        return None if last is None else self.spark.read.parquet(f"{self.base}/tables/{kind}/{dataset}/{last['version']}")
