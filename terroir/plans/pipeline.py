"""The preprocessing pipeline as one lazy plan with a few fitted parameters.

trim labels (P2) -> de-duplicate (U2) -> engineer (F7) -> split (X1) -> encode the
target with a train-only mapping (F8) -> clip to train IQR bounds (A3/P15) -> min-max
scale fitted on the clipped train rows (F9) -> prune columns (P3).

The fits (split cuts, label mapping, bounds, min/max) are the only actions before
the caller's write; each is one distributed aggregation returning one value per
column (or per class).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import clean as C
from ..operators import transform as X
from ..operators import validate as V
from ..session import shared_path
from ..sources import proxies as P


def engineer(df: DataFrame, plan=("fertility_score",)) -> tuple[DataFrame, list[str], list[str]]:
    """add each planned feature whose inputs exist; report created and skipped."""
    needs = {"fertility_score": (["N", "P", "K"], FX.fertility_score),
             "soil_quality_index": (["N", "P", "K", "organic_carbon", "ph"], FX.soil_quality_index),
             "soil_health_score": (["N", "P", "K", "organic_carbon", "ph", "moisture"], FX.soil_health_score)}
    created, skipped = [], []
    for name in plan:
        cols, fn = needs[name]
        if all(c in df.columns for c in cols):
            df = df.withColumn(name, fn())
            created.append(name)
        else:
            skipped.append(name)
    return df, created, skipped


def fit(split_df: DataFrame, features=P.FEATURES, target: str = "crop", plan=("fertility_score",)) -> dict[str, DataFrame]:
    """The fitted parameters of the steps after the split, as tables: ``encoder (label, code)``, ``bounds (column, q1, q3,
    lower, upper)`` and ``scaler (column, low, high)``, all from the training rows."""
    df, created, _ = engineer(split_df, plan)
    feats = list(features) + created
    train = df.filter(F.col("split") == "train")
    spark = df.sparkSession
    bounds = C.iqr_bounds(train, feats)
    ranges = X.minmax_params(C.clip_to_bounds(train, bounds), feats)
    return {"encoder": X.label_mapping(train, target).select(F.col(target).alias("label"), "code"),
            "bounds": spark.createDataFrame([(b.column, b.q1, b.q3, b.lower, b.upper) for b in bounds.values()], "column string, q1 double, q3 double, lower double, upper double"),
            "scaler": spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in ranges.items()], "column string, low double, high double")}


def apply(split_df: DataFrame, fitted: dict[str, DataFrame], features=P.FEATURES, target: str = "crop", id_col: str = "sample_id",
          plan=("fertility_score",)) -> DataFrame:
    """Encode, clip, scale and prune with the tables of ``fit``, new or loaded (a row for each column or label)."""
    df, created, _ = engineer(split_df, plan)
    feats = list(features) + created
    df = X.encode_labels(df, target, fitted["encoder"].withColumnRenamed("label", target), out=f"{target}_encoded")
    df = C.clip_to_bounds(df, {r["column"]: C.Bounds(*r) for r in fitted["bounds"].collect()})
    df = X.minmax_apply(df, {r["column"]: (r["low"], r["high"]) for r in fitted["scaler"].collect()})
    return V.prune_columns(df, [id_col, "split", f"{target}_encoded"] + feats)


def run_pipeline(split_df: DataFrame, features=P.FEATURES, target: str = "crop", id_col: str = "sample_id",
                 plan=("fertility_score",)) -> DataFrame:
    """Steps after the split: encode, clip, scale, prune.  ``split_df`` has a ``split`` column."""
    return apply(split_df, fit(split_df, features, target, plan), features, target, id_col, plan)


def split_samples(df: DataFrame, target: str = "crop", id_col: str = "sample_id") -> DataFrame:
    """Trimmed, de-duplicated and split rows.  Every fit reads them again, so they are stored once, in the shared folder."""
    path = shared_path(df.sparkSession, f"x09-{uuid.uuid4().hex}")
    rows = C.remove_duplicates(V.trim_labels(df))
    rows.write.parquet(f"{path}/rows")
    X.stratified_split(df.sparkSession.read.parquet(f"{path}/rows"), target, id_col).write.parquet(f"{path}/split")
    return df.sparkSession.read.parquet(f"{path}/split")


def preprocess(df: DataFrame, features=P.FEATURES, target: str = "crop", id_col: str = "sample_id") -> DataFrame:
    """The full pipeline from a raw-but-canonical table."""
    return run_pipeline(split_samples(df, target, id_col), features, target, id_col)
