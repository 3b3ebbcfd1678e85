"""Feature, encoding, split and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import transform as X
from ..sources import proxies as P
from .catalog import register
from .common import samples_split
from .oracle_views import with_views

FEATURES = P.FEATURES
R6 = lambda c: F.round(c, 6)
NUTRIENT_SQL = ("CASE WHEN N < 40 THEN 'Nitrogen deficient' WHEN P < 20 THEN 'Phosphorus deficient' "
                "WHEN K < 30 THEN 'Potassium deficient' ELSE 'Balanced' END")
HEALTH_RAW = ("(N / 200.0 * 25.0 + P / 200.0 * 20.0 + K / 200.0 * 20.0 + organic_carbon / 5.0 * 15.0 "
              "+ (1.0 - abs(ph - 6.5) / 7.0) * 10.0 + moisture / 100.0 * 10.0)")


# --- F1, F2, F3, F5, F6 -----------------------------------------------------------------
@register("f01_engineered_features", with_views(f"""
SELECT sample_id, round((N + P + K) / 3.0, 6) AS fertility_score,
  round(0.3 * N + 0.25 * P + 0.25 * K + 0.1 * organic_carbon - 0.1 * abs(ph - 6.5), 6) AS soil_quality_index,
  cast(round(cast(cast(least(greatest({HEALTH_RAW} * 100.0, 0.0), 100.0) as varchar) as decimal(38, 10)), 1) as double) AS soil_health_score,
  {NUTRIENT_SQL} AS nutrient_status,
  CASE WHEN N < 40 THEN 1 WHEN P < 20 THEN 2 WHEN K < 30 THEN 3 ELSE 0 END AS nutrient_code,
  CASE lower(trim(season)) WHEN 'kharif' THEN 0 WHEN 'rabi' THEN 1 WHEN 'summer' THEN 2 ELSE 0 END AS season_encoded
FROM samples""", "samples"))
def f01_engineered_features(spark, sf):
    s = P.samples(spark, sf)
    return s.select("sample_id", R6(FX.fertility_score()).alias("fertility_score"),
                    R6(FX.soil_quality_index()).alias("soil_quality_index"),
                    FX.soil_health_score().alias("soil_health_score"),
                    FX.nutrient_status().alias("nutrient_status"), FX.nutrient_status_code().alias("nutrient_code"),
                    FX.season_code().alias("season_encoded"))


# --- F4 ---------------------------------------------------------------------------------
@register("f04_region_code", with_views("""
SELECT DISTINCT region, cast(dense_rank() OVER (ORDER BY region) - 1 as int) AS region_code FROM samples""", "samples"))
def f04_region_code(spark, sf):
    return X.region_code(P.samples(spark, sf)).select("region", "region_code").distinct()


# --- W7 ---------------------------------------------------------------------------------
@register("w07_label_codes", with_views("""
SELECT crop, cast(dense_rank() OVER (ORDER BY crop) - 1 as int) AS code FROM (SELECT DISTINCT crop FROM samples)""",
                                        "samples"))
def w07_label_codes(spark, sf):
    return X.label_mapping(P.samples(spark, sf), "crop")


# --- F8: mapping fitted on train rows outside Asia, applied to every row -----------------
@register("f08_encode_unseen", with_views("""
WITH m AS (SELECT region, dense_rank() OVER (ORDER BY region) - 1 AS code
           FROM (SELECT DISTINCT region FROM samples_split WHERE split = 'train' AND state <> 'ASIA'))
SELECT s.region, cast(coalesce(m.code, -1) as int) AS region_encoded, count(*) AS n
FROM samples_split s LEFT JOIN m ON s.region = m.region GROUP BY ALL""", "samples_split"))
def f08_encode_unseen(spark, sf):
    sp = samples_split(spark, sf)
    mapping = X.label_mapping(sp.filter((F.col("split") == "train") & (F.col("state") != "ASIA")), "region")
    enc = X.encode_labels(sp, "region", mapping, out="region_encoded")
    return enc.groupBy("region", "region_encoded").agg(F.count("*").alias("n"))


# --- X1 / X2 ----------------------------------------------------------------------------
@register("x01_stratified_split", with_views("""
SELECT crop, split, count(*) AS n, min(sample_id) AS min_id, max(sample_id) AS max_id FROM samples_split GROUP BY ALL""",
                                             "samples_split"))
def x01_stratified_split(spark, sf):
    return (samples_split(spark, sf).groupBy("crop", "split")
            .agg(F.count("*").alias("n"), F.min("sample_id").alias("min_id"), F.max("sample_id").alias("max_id")))


# --- X3 ---------------------------------------------------------------------------------
@register("x03_stratified_folds", with_views("""
WITH r AS (SELECT crop, sample_id, row_number() OVER (PARTITION BY crop ORDER BY md5(concat_ws('#', sample_id, '42'))) - 1 AS rk,
                  count(*) OVER (PARTITION BY crop) AS n FROM samples)
SELECT crop, cast(rk * 5 // n as int) AS fold, count(*) AS n, min(sample_id) AS min_id FROM r GROUP BY ALL""", "samples"))
def x03_stratified_folds(spark, sf):
    f = X.stratified_folds(P.samples(spark, sf), "crop", "sample_id", k=5)
    return f.groupBy("crop", "fold").agg(F.count("*").alias("n"), F.min("sample_id").alias("min_id"))


# --- X5 ---------------------------------------------------------------------------------
@register("x05_qcut_fertility", with_views("""
WITH f AS (SELECT (N + P + K) / 3.0 AS fs FROM samples),
e AS (SELECT quantile_cont(fs, 1 / 3) AS e1, quantile_cont(fs, 2 / 3) AS e2 FROM f)
SELECT CASE WHEN fs <= e1 THEN 0 WHEN fs <= e2 THEN 1 ELSE 2 END AS bin, count(*) AS n, round(min(fs), 6) AS min,
       round(max(fs), 6) AS max FROM f, e GROUP BY 1""", "samples"))
def x05_qcut_fertility(spark, sf):
    s = P.samples(spark, sf).select(FX.fertility_score().alias("fs"))
    b = X.qcut(s, "fs", 3, out="bin")
    return b.groupBy("bin").agg(F.count("*").alias("n"), R6(F.min("fs")).alias("min"), R6(F.max("fs")).alias("max"))


# --- X7 ---------------------------------------------------------------------------------
@register("x07_reference_sample", with_views("""
SELECT sample_id FROM samples ORDER BY md5(concat_ws('#', sample_id, '42')), sample_id LIMIT 300""", "samples"))
def x07_reference_sample(spark, sf):
    return X.reference_sample(P.samples(spark, sf), "sample_id", 300).select("sample_id")


# --- F9 / A8 / A13: min-max scaling fitted on train ----------------------------------------
_MM = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES)


def _scaled_sql(c):
    return f"({c} - lo_{c}) / CASE WHEN hi_{c} - lo_{c} = 0 THEN 1.0 ELSE hi_{c} - lo_{c} END"


def _scaled(spark, sf):
    sp = samples_split(spark, sf)
    params = X.minmax_params(sp.filter(F.col("split") == "train"), FEATURES)
    return X.minmax_apply(sp, params)


@register("a08_scaling_check", with_views(f"""
WITH p AS (SELECT {_MM} FROM samples_split WHERE split = 'train'),
s AS (SELECT split, {', '.join(f'{_scaled_sql(c)} AS {c}' for c in FEATURES)} FROM samples_split, p)
{' UNION ALL '.join(f"SELECT split, '{c}' AS \"column\", round(min({c}), 6) AS min, round(max({c}), 6) AS max, "
                    f"min({c}) >= -0.05 AND max({c}) <= 1.05 AS in_range FROM s GROUP BY split" for c in FEATURES)}""",
                                          "samples_split"))
def a08_scaling_check(spark, sf):
    sc = _scaled(spark, sf)
    items = [F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in FEATURES]
    long = sc.select("split", F.inline(F.array(*items)))
    g = long.groupBy("split", "column").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    return g.select("split", "column", R6(F.col("mn")).alias("min"), R6(F.col("mx")).alias("max"),
                    ((F.col("mn") >= -0.05) & (F.col("mx") <= 1.05)).alias("in_range"))


@register("a13_scale_report", with_views(f"""
WITH p AS (SELECT {_MM} FROM samples_split WHERE split = 'train'),
s AS (SELECT split, {', '.join(f'{_scaled_sql(c)} AS {c}' for c in FEATURES)} FROM samples_split, p)
SELECT split, round(least({', '.join(f'min({c})' for c in FEATURES)}), 6) AS scaled_min,
       round(greatest({', '.join(f'max({c})' for c in FEATURES)}), 6) AS scaled_max FROM s GROUP BY split""",
                                         "samples_split"))
def a13_scale_report(spark, sf):
    sc = _scaled(spark, sf)
    return sc.groupBy("split").agg(R6(F.least(*[F.min(c) for c in FEATURES])).alias("scaled_min"),
                                   R6(F.greatest(*[F.max(c) for c in FEATURES])).alias("scaled_max"))


# --- A11 --------------------------------------------------------------------------------
@register("a11_class_share_drift", with_views("""
WITH c AS (SELECT split, crop, count(*) AS n FROM samples_split GROUP BY ALL),
t AS (SELECT split, sum(n) AS tot FROM c GROUP BY split),
s AS (SELECT c.split, crop, cast(n as double) / tot AS share FROM c JOIN t USING (split)),
p AS (SELECT a.crop, a.share AS train_share, b.split AS other, b.share AS other_share
      FROM s a JOIN s b ON a.crop = b.crop AND a.split = 'train' AND b.split <> 'train')
SELECT other AS compared_split, round(max(abs(train_share - other_share)), 6) AS max_abs_diff,
       max(abs(train_share - other_share)) < 0.05 AS passes FROM p GROUP BY other""", "samples_split"))
def a11_class_share_drift(spark, sf):
    sp = samples_split(spark, sf)
    c = sp.groupBy("split", "crop").agg(F.count("*").alias("n"))
    t = c.groupBy("split").agg(F.sum("n").alias("tot"))
    s = c.join(t, "split").select("split", "crop", (F.col("n") / F.col("tot")).alias("share"))
    wide = s.groupBy("crop").pivot("split", ["train", "val", "test"]).agg(F.first("share"))
    long = wide.select("crop", "train", F.inline(F.array(
        F.struct(F.lit("val").alias("compared_split"), F.col("val").alias("other")),
        F.struct(F.lit("test").alias("compared_split"), F.col("test").alias("other")))))
    d = long.groupBy("compared_split").agg(F.max(F.abs(F.col("train") - F.col("other"))).alias("m"))
    return d.select("compared_split", R6(F.col("m")).alias("max_abs_diff"), (F.col("m") < 0.05).alias("passes"))


# --- J13 --------------------------------------------------------------------------------
@register("j13_split_overlap", with_views("""
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared_ids
FROM (SELECT DISTINCT sample_id, split FROM samples_split) a
JOIN (SELECT DISTINCT sample_id, split FROM samples_split) b ON a.sample_id = b.sample_id AND a.split < b.split
GROUP BY ALL
UNION ALL SELECT 'any', 'any', count(*) FROM (SELECT sample_id FROM samples_split GROUP BY sample_id
                                             HAVING count(DISTINCT split) > 1)""", "samples_split"))
def j13_split_overlap(spark, sf):
    sp = samples_split(spark, sf).select("sample_id", "split").distinct()
    a, b = sp.alias("a"), sp.alias("b")
    pairs = (a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.split") < F.col("b.split")))
             .groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b"))
             .agg(F.count("*").alias("shared_ids")))
    multi = (sp.groupBy("sample_id").agg(F.count_distinct("split").alias("k")).filter("k > 1")
             .agg(F.count("*").alias("shared_ids")).select(F.lit("any").alias("split_a"), F.lit("any").alias("split_b"),
                                                           "shared_ids"))
    return pairs.unionByName(multi)


# --- A15 --------------------------------------------------------------------------------
@register("a15_class_weights", with_views("""
WITH c AS (SELECT crop, count(*) AS nc FROM samples_split WHERE split = 'train' GROUP BY crop),
t AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT crop, round(cast(n as double) / (cast(k as double) * nc), 6) AS weight FROM c, t""", "samples_split"))
def a15_class_weights(spark, sf):
    from ..operators import evaluate as EV
    train = samples_split(spark, sf).filter(F.col("split") == "train")
    return EV.balanced_weights(train, "crop").select("crop", R6(F.col("weight")).alias("weight")).distinct()


# --- X9: preprocessing pipeline ------------------------------------------------------------
PIPE_FEATURES = FEATURES + ["fertility_score"]


PIPELINE_SQL = with_views(f"""
WITH e AS (SELECT DISTINCT * FROM samples_split),
f AS (SELECT *, (N + P + K) / 3.0 AS fertility_score FROM e),
b AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM f WHERE split = 'train'" for c in PIPE_FEATURES)}),
bw AS (SELECT {', '.join(f"max(CASE WHEN c = '{c}' THEN q1 - 1.5 * (q3 - q1) END) AS lo_{c}, max(CASE WHEN c = '{c}' THEN q3 + 1.5 * (q3 - q1) END) AS hi_{c}" for c in PIPE_FEATURES)} FROM b),
cl AS (SELECT sample_id, split, crop, {', '.join(f'least(greatest({c}, lo_{c}), hi_{c}) AS {c}' for c in PIPE_FEATURES)} FROM f, bw),
mm AS (SELECT {', '.join(f'min({c}) AS mn_{c}, max({c}) AS mx_{c}' for c in PIPE_FEATURES)} FROM cl WHERE split = 'train'),
m AS (SELECT crop, dense_rank() OVER (ORDER BY crop) - 1 AS code FROM (SELECT DISTINCT crop FROM cl WHERE split = 'train')),
sc AS (SELECT split, coalesce(m.code, -1) AS crop_code,
       {', '.join(f'({c} - mn_{c}) / CASE WHEN mx_{c} - mn_{c} = 0 THEN 1.0 ELSE mx_{c} - mn_{c} END AS {c}' for c in PIPE_FEATURES)}
       FROM cl LEFT JOIN m USING (crop), mm)
SELECT split, count(*) AS n, sum(crop_code) AS code_sum, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in PIPE_FEATURES)}
FROM sc GROUP BY split""", "samples_split")


@register("x09_pipeline", PIPELINE_SQL)
def x09_pipeline(spark, sf):
    from .pipeline import preprocess
    out = preprocess(P.samples(spark, sf))
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum("crop_encoded").cast("bigint").alias("code_sum"),
                                    *[R6(F.avg(c)).alias(f"avg_{c}") for c in PIPE_FEATURES])
