"""Scoring-input and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import scoring as SC
from ..operators import transform as X
from ..operators import validate as V
from ..sources import knowledge as K
from ..sources import proxies as P
from .catalog import register
from .oracle_views import with_views

R6 = lambda c: F.round(c, 6)
CLUSTERS = 10


# --- X6: nearest centroid ------------------------------------------------------------------------------
@register("x06_nearest_centroid", with_views(f"""
WITH pts AS (SELECT point_id, lat, CASE WHEN point_id % 50 <> 0 THEN lon END AS lon, cast(floor((lon + 2) / 6) as int) AS band FROM points),
centroids AS (SELECT band, round(avg(lat), 6) AS clat, round(avg(lon), 6) AS clon FROM pts WHERE band < {CLUSTERS} GROUP BY band),
best AS (SELECT point_id, arg_min(band, (d, band)) AS cluster
         FROM (SELECT point_id, centroids.band, (lat - clat) * (lat - clat) + (lon - clon) * (lon - clon) AS d FROM pts CROSS JOIN centroids WHERE lon IS NOT NULL)
         GROUP BY point_id)
SELECT coalesce(cluster, 0) AS lat_lon_cluster, count(*) AS n, sum(pts.point_id)::bigint AS id_sum FROM pts LEFT JOIN best USING (point_id) GROUP BY ALL""",
                                             "points"))
def x06_nearest_centroid(spark, sf):
    pts = P.points(spark, sf).withColumn("band", F.floor((F.col("lon") + 2) / 6).cast("int")).withColumn(
        "lon", F.when(F.col("point_id") % 50 != 0, F.col("lon")))
    centres = (pts.filter(F.col("band") < CLUSTERS).groupBy("band").agg(R6(F.avg("lat")).alias("lat"), R6(F.avg("lon")).alias("lon"))
               .orderBy("band").collect())   # one row per cluster
    return SC.nearest_centroid(pts, [(r["lat"], r["lon"]) for r in centres]).groupBy("lat_lon_cluster").agg(
        F.count("*").alias("n"), F.sum("point_id").alias("id_sum"))


@register("x06_kmeans")
def x06_kmeans(spark, sf):
    """X6 whole: KMeans(k = 10) fitted on all points that have both coordinates, every point assigned to its centroid."""
    pts = P.points(spark, sf).withColumn("lon", F.when(F.col("point_id") % 50 != 0, F.col("lon")))
    centres = SC.fit_centroids(pts, k=CLUSTERS)
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "lat_lon_cluster int, centre_lat double, centre_lon double")
    return SC.nearest_centroid(pts, centres).groupBy("lat_lon_cluster").agg(F.count("*").alias("n")).join(table, "lat_lon_cluster")


# --- X8: scoring feature assembly ------------------------------------------------------------------------
_NAMES = P.ALL_NUMERIC + ["fertility_score", "soil_quality_index", "season_encoded", "lat_lon_cluster", "region_code"]
_VALID = " AND ".join(f"coalesce({c} >= {lo}{f' AND {c} <= {hi}' if hi is not None else ''}, true)" for c, (lo, hi) in K.ROW_BOUNDS.items())


def _assembled_sql(view):
    return f"""SELECT {', '.join(P.ALL_NUMERIC)}, {_VALID} AS valid, (N + P + K) / 3.0 AS fertility_score,
  0.3 * N + 0.25 * P + 0.25 * K + 0.1 * organic_carbon - 0.1 * abs(ph - 6.5) AS soil_quality_index,
  CASE lower(trim(season)) WHEN 'rabi' THEN 1 WHEN 'summer' THEN 2 ELSE 0 END AS season_encoded,
  CASE WHEN N IS NULL OR K IS NULL THEN 0 ELSE list_min(list_transform(cs, lambda c: struct_pack(
    d := (N / 10.0::DOUBLE - c.lat) * (N / 10.0::DOUBLE - c.lat) + (K / 10.0::DOUBLE - c.lon) * (K / 10.0::DOUBLE - c.lon), i := c.i))).i END AS lat_lon_cluster,
  code AS region_code FROM {view} JOIN states USING (state), centroids"""


def _placed(samples):
    """A position for each sample, made of two measurements (the tables hold none)."""
    return samples.withColumns({"lat": F.col("N") / FX.dlit(10), "lon": F.col("K") / FX.dlit(10)})


@register("x08_scoring_features", with_views(f"""
WITH states AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS code FROM (SELECT DISTINCT state FROM samples)),
centroids AS (SELECT list(struct_pack(i := i, lat := lat, lon := lon) ORDER BY i) AS cs FROM (
  SELECT row_number() OVER (ORDER BY band) - 1 AS i, lat, lon FROM (
    SELECT floor(K / 21) AS band, round(avg(N / 10.0::DOUBLE), 6) AS lat, round(avg(K / 10.0::DOUBLE), 6) AS lon FROM samples GROUP BY 1))),
fit AS (SELECT * FROM ({_assembled_sql('samples')}) WHERE valid),
apply AS ({_assembled_sql('(SELECT * REPLACE (CASE WHEN noise = 5 THEN 500.0 ELSE moisture END AS moisture) FROM samples_dirty)')}),
lim AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in _NAMES)} FROM fit)
SELECT count(*) AS n, count_if(valid) AS n_valid,
       {', '.join(f'round(sum(CASE WHEN valid THEN ({c} - lo_{c}) / cast(CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END as double) END), 6) AS sum_{c}' for c in _NAMES)}
FROM apply CROSS JOIN lim""", "samples_dirty"))
def x08_scoring_features(spark, sf):
    s = _placed(P.samples(spark, sf))
    states = X.label_mapping(s, "state")
    bands = s.groupBy(F.floor(F.col("K") / 21).alias("band")).agg(R6(F.avg("lat")).alias("lat"), R6(F.avg("lon")).alias("lon"))
    centroids = [(r["lat"], r["lon"]) for r in bands.orderBy("band").collect()]   # ten bands
    fitted, names = SC.assemble(s, P.ALL_NUMERIC, centroids, states=states)
    params = X.minmax_params(fitted, names)
    rows = _placed(P.samples_dirty(spark, sf)).withColumn("moisture", F.when(F.col("noise") == 5, FX.dlit(500)).otherwise(F.col("moisture")))
    scored, _ = SC.assemble(rows, P.ALL_NUMERIC, centroids, states=states)
    return X.minmax_apply(scored, params).agg(
        F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), *[R6(F.sum(c)).alias(f"sum_{c}") for c in names])


# --- A30: processed-data validation -----------------------------------------------------------------------------
_RANGES = K.HARD_BOUNDS | K.SOFT_BOUNDS
_A30 = [*dict.fromkeys([*P.ALL_NUMERIC, "field_depth", *_RANGES])]


def _a30_sql():
    rows = []
    for c in _A30:
        if c == "field_depth":
            rows.append(f"SELECT '{c}' AS feature, 'feature' AS role, NULL::double AS min, NULL::double AS max, NULL::bigint AS nulls, 'MISSING' AS status")
        elif c in _RANGES:
            lo, hi = _RANGES[c]
            rows.append(f"SELECT '{c}', 'feature', min({c}), max({c}), count_if({c} IS NULL)::bigint, "
                        f"CASE WHEN min({c}) < {lo} - 0.01 OR max({c}) > {hi} + 0.01 THEN 'CLIP/FAIL' ELSE 'PASS' END FROM d")
        else:
            rows.append(f"SELECT '{c}', 'feature', NULL, NULL, count_if({c} IS NULL)::bigint, 'PASS' FROM d")
    rows.append("SELECT 'crop', 'target', NULL, NULL, count_if(crop IS NULL)::bigint, 'PASS' FROM d")
    rows.sort(key=lambda r: "AS feature" not in r)   # the row that names the columns comes first
    return " UNION ALL ".join(rows)


@register("a30_processed_validation", with_views(
    f"WITH d AS (SELECT * REPLACE (moisture + 0.005 AS moisture, humidity + 10 AS humidity) FROM samples_dirty) {_a30_sql()}", "samples_dirty"))
def a30_processed_validation(spark, sf):
    d = P.samples_dirty(spark, sf).withColumns({"moisture": F.col("moisture") + FX.dlit(0.005), "humidity": F.col("humidity") + FX.dlit(10)})
    return V.range_status(d, [*P.ALL_NUMERIC, "field_depth"], "crop")


# --- P18: pipeline gate ---------------------------------------------------------------------------------------------
def _gate_sql(name, view, target, cols):
    hard = " OR ".join(f"count_if({c} < {lo} OR {c} > {hi}) > 0" for c, (lo, hi) in K.HARD_BOUNDS.items() if c in cols)
    soft = " OR ".join(f"count_if({c} < {lo} OR {c} > {hi}) > 0" for c, (lo, hi) in K.SOFT_BOUNDS.items() if c in cols)
    return (f"SELECT '{name}' AS dataset, CASE WHEN {hard} THEN 'CRITICAL' WHEN {soft} THEN 'WARN' ELSE 'PASS' END AS severity, "
            f"{'NULL' if target else chr(39) + 'Missing target column: crop' + chr(39)} AS err FROM {view}")


_TELEMETRY = ["N", "P", "K", "ph", "temperature", "humidity", "rainfall"]


@register("p18_pipeline_gate", with_views(f"""
WITH tenths AS (SELECT * REPLACE (rainfall * 20 AS rainfall) FROM telemetry),
g AS ({_gate_sql('samples', 'samples', True, P.ALL_NUMERIC)} UNION ALL {_gate_sql('samples_dirty', 'samples_dirty', True, P.ALL_NUMERIC)}
      UNION ALL {_gate_sql('telemetry', 'telemetry', False, _TELEMETRY)} UNION ALL {_gate_sql('telemetry_tenths', 'tenths', False, _TELEMETRY)})
SELECT dataset, severity, CASE WHEN severity = 'CRITICAL' OR err IS NOT NULL THEN 'skipped' ELSE 'processed' END AS status,
       CASE WHEN severity <> 'CRITICAL' THEN err END AS error FROM g""", "samples_dirty", "telemetry"))
def p18_pipeline_gate(spark, sf):
    telemetry = P.telemetry(spark, sf)
    need = ["N", "P", "K"]
    return V.pipeline_gate({"samples": (P.samples(spark, sf), "crop", need), "samples_dirty": (P.samples_dirty(spark, sf), "crop", need),
                            "telemetry": (telemetry, "crop", need),
                            "telemetry_tenths": (telemetry.withColumn("rainfall", F.col("rainfall") * 20), "crop", need)})
