"""Model registry, experiment log and artifact store.

The registry is a table of entries ``(version, model_name, task, dataset, training_timestamp,
features, artifact_path, artifact_exists, metrics map<string,double>, position)``; ``position`` is the order
in which entries were added and settles ties (the first wins).  It is written as JSON/Parquet under the cluster's shared folder and merged with joins, never in driver loops.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .artifacts import path_exists

ENTRY_SCHEMA = ("version string, model_name string, task string, dataset string, training_timestamp string, "
                "features array<string>, artifact_path string, artifact_exists boolean, metrics map<string,double>, position long")


def entries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Registry entries from collected training results (one row per model)."""
    data = [(r.get("version", "v1"), r["model_name"], r["task"], r.get("dataset", r["task"]), r["training_timestamp"],
             list(r.get("features", [])), r.get("artifact_path", ""), bool(r.get("artifact_exists", True)),
             {k: float(v) for k, v in r["metrics"].items() if v is not None}, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ENTRY_SCHEMA)


def write_json(df: DataFrame, path: str) -> None:
    """JSON sink."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON source; malformed records are kept as nulls (PERMISSIVE), an absent file is an empty registry."""
    try:
        return spark.read.schema(ENTRY_SCHEMA).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY_SCHEMA)


def append_log(df: DataFrame, path: str) -> None:
    """Experiment log - one appended row per run (params/metrics as maps)."""
    df.write.mode("append").parquet(path)


def merge_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append entries whose (model, task) is new (the registry keeps known entries)."""
    after = existing.agg(F.coalesce(F.max("position") + 1, F.lit(0))).first()[0]
    added = new.join(existing.select("model_name", "task"), ["model_name", "task"], "left_anti")
    return existing.unionByName(added.withColumn("position", F.col("position") + F.lit(after)))


def best_model(reg: DataFrame, task: str, name: str | None = None) -> DataFrame:
    """The wanted name if present, else the best test accuracy (crop accuracy as fallback),
    among entries whose artifact exists; the first entry wins ties."""
    acc = F.coalesce(F.col("metrics")["test_accuracy"], F.col("metrics")["crop_accuracy"], F.lit(-1.0))
    pref = (F.col("model_name") == F.lit(name)) if name else F.lit(False)
    cand = reg.filter((F.col("task") == task) & F.col("artifact_exists"))
    return cand.agg(F.max_by(F.struct(*reg.columns), F.struct(pref.cast("int"), acc, -F.col("position"))).alias("b")).select("b.*")


def benchmark_table(reg: DataFrame) -> DataFrame:
    """Comparison table ranked by test accuracy per task (first entry wins ties)."""
    m = F.col("metrics")
    t = reg.select("model_name", "task", m["val_accuracy"].alias("val_accuracy"), m["test_accuracy"].alias("test_accuracy"),
                   m["test_macro_f1"].alias("test_f1"), m["train_seconds"].alias("train_seconds"), "position")
    w = Window.partitionBy("task").orderBy(F.col("test_accuracy").desc_nulls_last(), "position")
    return t.withColumn("rank", F.row_number().over(w)).drop("position")


def save_artifact(model, path: str) -> str:
    """Persist a fitted model or pipeline (missing -> None on load)."""
    model.write().overwrite().save(path)
    return path


def load_artifact(spark: SparkSession, loader, path: str):
    """A saved model, or None if nothing was saved there; a model that cannot be read raises."""
    return loader.load(path) if path_exists(spark, path) else None
