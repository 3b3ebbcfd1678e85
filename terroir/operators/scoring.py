"""Scoring inputs as whole-table operators: nearest-centroid cluster (X6) and feature assembly."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FX
from ..sources import knowledge as K
from . import transform as X
from . import validate as V

#: Engineered features in their order after the raw ones: column, inputs, expression.
ENGINEERED = [("fertility_score", ["N", "P", "K"], FX.fertility_score),
              ("soil_quality_index", ["N", "P", "K", "organic_carbon", "ph"], FX.soil_quality_index),
              ("season_encoded", ["season"], FX.season_code)]


def fit_centroids(df: DataFrame, cols=("lat", "lon"), k: int = 10, seed: int = K.SEED) -> list[tuple[float, ...]]:
    """X6 fit: ``k`` centroids of the rows that have all of ``cols`` (a bounded list)."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df.select(*cols))
    return [tuple(float(x) for x in c) for c in KMeans(k=k, seed=seed, featuresCol="_v").fit(rows).clusterCenters()]


def nearest_centroid(df: DataFrame, centroids, cols=("lat", "lon"), out: str = "lat_lon_cluster") -> DataFrame:
    """Index of the nearest centroid (ties: the first); 0 without centroids, columns or values."""
    known = [c for c in cols if c in df.columns]
    if len(known) < len(cols) or not centroids:
        return df.withColumn(out, F.lit(0))
    items = []
    for i, centre in enumerate(centroids):
        distance = sum(((F.col(c) - FX.dlit(x)) * (F.col(c) - FX.dlit(x)) for c, x in zip(cols, centre)), FX.dlit(0))
        items.append(F.struct(distance.alias("d"), F.lit(i).alias("i")))
    present = ~F.greatest(*[F.coalesce(F.isnan(c), F.lit(False)) | F.col(c).isNull() for c in cols], F.lit(False))
    return df.withColumn(out, F.when(present, F.array_min(F.array(*items))["i"]).otherwise(F.lit(0)))


def assemble(df: DataFrame, raw_features, centroids=(), states: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Validated rows with the raw features there are and the engineered ones whose inputs exist.

    ``states`` maps ``state`` to ``code`` (unknown: 0).  Adds ``valid`` and ``errors`` (P5), ``soil_health_score``
    and the features; returns the rows and the feature names in order.  Features of an invalid row are null.
    """
    names = [c for c in raw_features if c in df.columns]
    df = V.row_errors(df)
    for name, needs, fn in ENGINEERED:
        if all(c in df.columns for c in needs):
            df = df.withColumn(name, fn())
            names.append(name)
    if all(c in df.columns for c in ("N", "P", "K", "organic_carbon", "ph", "moisture")):
        df = df.withColumn("soil_health_score", FX.soil_health_score())
    df = nearest_centroid(df, centroids)
    names.append("lat_lon_cluster")
    if "state" in df.columns:
        df = X.encode_labels(df, "state", states, out="region_code", unknown=0) if states is not None else df.withColumn("region_code", F.lit(0))
        names.append("region_code")
    return df.withColumns({c: F.when(F.col("valid"), F.col(c).cast("double")) for c in names}), names
