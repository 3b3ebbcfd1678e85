"""Flagship and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import profile as PR
from ..sources import proxies as P
from .catalog import register
from .oracle_views import with_views

FEATURES = P.FEATURES
R6 = lambda c: F.round(c, 6)  # noqa: E731  aggregated doubles are compared at 6 decimals

NUTRIENT_SQL = ("CASE WHEN N < 40 THEN 'Nitrogen deficient' WHEN P < 20 THEN 'Phosphorus deficient' "
                "WHEN K < 30 THEN 'Potassium deficient' ELSE 'Balanced' END")


# --- flagship: nutrient-status counts and mean fertility score per region -----------------
def flagship(spark, sf):
    s = P.samples(spark, sf)
    return (s.select("region", FX.nutrient_status().alias("nutrient_status"), FX.fertility_score().alias("fs"))
            .groupBy("region", "nutrient_status")
            .agg(F.count("*").alias("n_samples"), R6(F.avg("fs")).alias("mean_fertility_score")))


register("q00_flagship_nutrient_by_region", with_views(f"""
SELECT region, {NUTRIENT_SQL} AS nutrient_status, count(*) AS n_samples,
       round(avg((N + P + K) / cast(3 as double)), 6) AS mean_fertility_score
FROM samples GROUP BY ALL""", "samples"))(flagship)


# --- A1 ---------------------------------------------------------------------------------
DIRTY_COLS = ["sample_id", "N", "P", "K", "ph", "ec", "organic_carbon", "moisture", "temperature", "humidity",
              "rainfall", "season", "state", "region", "crop_code", "crop", "noise"]


@register("a01_table_profile", with_views(
    "SELECT 'rows' AS metric, '*' AS \"column\", count(*) AS value FROM samples_dirty\n"
    f"UNION ALL SELECT 'columns', '*', {len(DIRTY_COLS)}::bigint\n"
    "UNION ALL SELECT 'duplicates', '*', (SELECT count(*) FROM samples_dirty) - "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM samples_dirty))\n"
    + "\n".join(f"UNION ALL SELECT 'nulls', '{c}', count_if({c} IS NULL) FROM samples_dirty" for c in DIRTY_COLS),
    "samples_dirty"))
def a01_table_profile(spark, sf):
    return PR.table_profile(P.samples_dirty(spark, sf))


# --- A2 ---------------------------------------------------------------------------------
_DBL = ["N", "P", "K", "ph", "ec", "organic_carbon", "moisture", "temperature", "humidity", "rainfall"]


@register("a02_integrity", with_views(f"""
WITH t AS (SELECT count(*) AS rows,
  ({' + '.join(f'count_if({c} IS NULL)' for c in DIRTY_COLS)})::bigint AS nulls,
  ({' + '.join(f'count_if(abs({c}) = cast(\'inf\' as double))' for c in _DBL)})::bigint AS infinities
  FROM samples_dirty),
d AS (SELECT (SELECT count(*) FROM samples_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM samples_dirty)) AS duplicates),
k AS (SELECT ({' + '.join(f"(typeof({c}) = 'DOUBLE')::int" for c in DIRTY_COLS)}) AS n_double,
             ({' + '.join(f"(typeof({c}) IN ('INTEGER', 'BIGINT'))::int" for c in DIRTY_COLS)}) AS n_integer,
             ({' + '.join(f"(typeof({c}) = 'VARCHAR')::int" for c in DIRTY_COLS)}) AS n_string
      FROM samples_dirty LIMIT 1)
SELECT rows, nulls, infinities, duplicates::bigint AS duplicates, '' AS missing_columns,
       n_double, n_integer, n_string, 0 AS n_other,
       CASE WHEN nulls = 0 AND infinities = 0 AND duplicates = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM t, d, k""", "samples_dirty"))
def a02_integrity(spark, sf):
    return PR.integrity(P.samples_dirty(spark, sf), required=FEATURES + ["crop"])


# --- A4 ---------------------------------------------------------------------------------
@register("a04_zscore_stats", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM samples"
    for c in FEATURES), "samples"))
def a04_zscore_stats(spark, sf):
    return PR.zscore_stats(P.samples(spark, sf), FEATURES).select("column", R6(F.col("mean")).alias("mean"),
                                                                  R6(F.col("std")).alias("std"))


# --- A5 ---------------------------------------------------------------------------------
@register("a05_feature_stats", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c}) AS min, max({c}) AS max, round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis, "
    f"stddev_samp({c}) < 1e-8 AS collapsed FROM samples" for c in FEATURES), "samples"))
def a05_feature_stats(spark, sf):
    fs = PR.feature_stats(P.samples(spark, sf), FEATURES)
    return fs.select("column", *[R6(F.col(c)).alias(c) for c in ("mean", "std")], "min", "max",
                     R6(F.col("skew")).alias("skew"), R6(F.col("kurtosis")).alias("kurtosis"), "collapsed")


# --- A6 ---------------------------------------------------------------------------------
@register("a06_describe", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM samples_dirty" for c in FEATURES),
    "samples_dirty"))
def a06_describe(spark, sf):
    d = PR.describe(P.samples_dirty(spark, sf), FEATURES)
    return d.select("column", "count", *[R6(F.col(c)).alias(c) for c in ("mean", "std")], "min",
                    *[R6(F.col(c)).alias(c) for c in ("q25", "q50", "q75")], "max")


# --- A7 ---------------------------------------------------------------------------------
@register("a07_target_distribution", with_views("""
WITH c AS (SELECT crop, count(*) AS count FROM samples WHERE crop IS NOT NULL GROUP BY crop),
t AS (SELECT sum(count) AS total, count(*) AS k, max(count) AS mx, min(count) AS mn FROM c)
SELECT crop, count, round(cast(count as double) / cast(total as double) * 100, 6) AS percent,
       round(cast(mx as double) / cast(mn as double), 6) AS imbalance_ratio,
       cast(count as double) / cast(total as double) < greatest(0.02, 0.3 / cast(k as double)) AS is_rare
FROM c, t""", "samples"))
def a07_target_distribution(spark, sf):
    d = PR.target_distribution(P.samples(spark, sf), "crop")
    return d.select("crop", "count", R6(F.col("percent")).alias("percent"),
                    R6(F.col("imbalance_ratio")).alias("imbalance_ratio"), "is_rare")


# --- A9 ---------------------------------------------------------------------------------
@register("a09_target_quality", with_views(f"""
SELECT count_if(crop IS NULL) AS null_labels, count(DISTINCT crop) AS distinct_labels,
  concat_ws(',', {', '.join(f"CASE WHEN abs(corr({c}, crop_code)) > 0.99 THEN '{c}' END" for c in FEATURES)}) AS leaking_features,
  false AS target_in_features
FROM samples""", "samples"))
def a09_target_quality(spark, sf):
    return PR.target_quality(P.samples(spark, sf), "crop", "crop_code", FEATURES)


# --- A10 --------------------------------------------------------------------------------
_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@register("a10_correlation", with_views("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM samples" for a, b in _PAIRS),
    "samples"))
def a10_correlation(spark, sf):
    return PR.correlation_pairs(P.samples(spark, sf), FEATURES).withColumn("corr", R6(F.col("corr")))


# --- A12 --------------------------------------------------------------------------------
_MI_PROBS = ", ".join(str(i / 10) for i in range(1, 10))


@register("a12_mutual_information", with_views(f"""
WITH e AS (SELECT {', '.join(f'quantile_cont({c}, [{_MI_PROBS}]) AS e_{c}' for c in FEATURES)} FROM samples),
long AS (
  {' UNION ALL '.join(
      f"SELECT '{c}' AS \"column\", crop AS y, (SELECT sum(CASE WHEN {c} > x THEN 1 ELSE 0 END) FROM unnest(e_{c}) t(x)) AS bin FROM samples, e"
      for c in FEATURES)}
),
j AS (SELECT "column", bin, y, count(*) AS nbc FROM long GROUP BY ALL),
b AS (SELECT "column", bin, sum(nbc) AS nb FROM j GROUP BY ALL),
c AS (SELECT "column", y, sum(nbc) AS nc FROM j GROUP BY ALL),
n AS (SELECT "column", sum(nbc) AS n FROM j GROUP BY ALL),
mi AS (SELECT j."column", sum((cast(nbc as double) / n) * ln((cast(nbc as double) * n) / (cast(nb as double) * nc))) AS mi
       FROM j JOIN b USING ("column", bin) JOIN c USING ("column", y) JOIN n USING ("column") GROUP BY j."column")
SELECT "column", round(mi, 6) AS mi, mi < 0.01 AS weak FROM mi""", "samples"))
def a12_mutual_information(spark, sf):
    m = PR.mutual_information(P.samples(spark, sf), FEATURES, "crop")
    return m.select("column", R6(F.col("mi")).alias("mi"), "weak")


# --- A22 --------------------------------------------------------------------------------
@register("a22_histograms", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN mx = mn THEN 1 ELSE least(30, cast(floor(({c} - mn) / (mx - mn) * cast(30 as double)) + 1 as int)) END AS bin, "
    f"count(*) AS count FROM samples, (SELECT min({c}) AS mn, max({c}) AS mx FROM samples) r WHERE {c} IS NOT NULL GROUP BY ALL"
    for c in FEATURES), "samples"))
def a22_histograms(spark, sf):
    return PR.histograms(P.samples(spark, sf), FEATURES)


# --- A23 --------------------------------------------------------------------------------
@register("a23_box_stats", with_views("\nUNION ALL\n".join(
    f"SELECT crop, '{c}' AS \"column\", min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max "
    f"FROM samples GROUP BY crop" for c in ["N", "P", "K"]), "samples"))
def a23_box_stats(spark, sf):
    b = PR.box_stats(P.samples(spark, sf), ["N", "P", "K"], "crop")
    return b.select("crop", "column", "min", *[R6(F.col(c)).alias(c) for c in ("q1", "median", "q3")], "max")
