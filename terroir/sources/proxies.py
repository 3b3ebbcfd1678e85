"""Agronomic views derived from the input tables.

The input tables are business tables, so every operator runs on views that Spark
derives from them; their size grows with the input.  ``samples`` has one soil sample
per line item, ``telemetry`` one field reading per event, and so on.  The same views
are written independently in SQL for the oracle (``plans/oracle_views.py``).

Join strategy: ``nation`` and ``region`` have a fixed size (25 and 5 rows), so they
are broadcast explicitly.  ``supplier`` grows with the data: it is broadcast only after
a row count shows it is under ``BROADCAST_ROWS``; above that the planner keeps a
shuffle join with the line items as the streamed side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .tables import Tables, spread

D = F.lit  # shorthand for literals; doubles are written as Python floats
BROADCAST_ROWS = 1_000_000   # data-sized dimension tables are broadcast only up to this many rows


def _dbl(c: Column) -> Column:
    return c.cast("double")


def nation_region(t: Tables) -> DataFrame:
    """25 nations with their region name (fixed size)."""
    nation = t.read("nation", "n_nationkey", "n_name", "n_regionkey")
    region = t.read("region", "r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "n_regionkey", "r_name")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One soil sample per line item (see FIXTURES for the column meanings)."""
    t = Tables(spark, sf_dir)
    li = spread(t.read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                       "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    sup = t.read("supplier", "s_suppkey", "s_nationkey")
    geo = sup.join(F.broadcast(nation_region(t)), sup.s_nationkey == F.col("n_nationkey"))
    # supplier grows with the data: broadcast it only behind a row-count check, so the
    # line items stay the streamed side; above the limit the planner keeps a shuffle join
    if sup.count() <= BROADCAST_ROWS:
        geo = F.broadcast(geo)
    j = li.join(geo, li.l_suppkey == geo.s_suppkey)
    month = F.month("l_shipdate")
    crop_code = ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 22).cast("int")
    return j.select(
        F.md5(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                          F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
                          F.col("l_shipdate").cast("date").cast("string"))).alias("sample_id"),
        (F.col("l_quantity") * D(4.0)).alias("N"),
        _dbl((F.col("l_partkey") % 41) * 5).alias("P"),
        _dbl((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 206).alias("K"),
        (D(4.0) + _dbl(F.col("l_partkey") % 50) / D(10.0)).alias("ph"),
        (F.col("l_discount") * D(20.0)).alias("ec"),
        (F.col("l_tax") * D(50.0)).alias("organic_carbon"),
        _dbl((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 101).alias("moisture"),
        _dbl(D(10) + F.col("l_orderkey") % 33).alias("temperature"),
        _dbl(D(20) + F.col("l_partkey") % 76).alias("humidity"),
        (F.col("l_extendedprice") / D(35.0)).alias("rainfall"),
        F.when(month.between(6, 10), "kharif").when(month.isin(4, 5), "summer").otherwise("rabi").alias("season"),
        F.col("r_name").alias("state"),
        F.col("n_name").alias("region"),
        crop_code.alias("crop_code"),
        dims.crop_name(crop_code).alias("crop"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).cast("int").alias("noise"),
    )


FEATURES = ["N", "P", "K", "temperature", "humidity", "ph", "rainfall"]
ALL_NUMERIC = ["N", "P", "K", "ph", "ec", "organic_carbon", "moisture", "temperature", "humidity", "rainfall"]


def samples_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples`` with missing values (noise = 0) and repeated rows (noise = 1).

    Where noise = 0 one measurement is missing, chosen by ``crop_code % 3``: N, ph or
    rainfall.  Rows with noise = 1 appear twice (exact duplicates).
    """
    s = samples(spark, sf_dir)
    miss = F.col("noise") == 0
    which = F.col("crop_code") % 3
    s = s.withColumns({
        "N": F.when(miss & (which == 0), F.lit(None).cast("double")).otherwise(F.col("N")),
        "ph": F.when(miss & (which == 1), F.lit(None).cast("double")).otherwise(F.col("ph")),
        "rainfall": F.when(miss & (which == 2), F.lit(None).cast("double")).otherwise(F.col("rainfall")),
    })
    return s.unionByName(s.filter(F.col("noise") == 1))


def class_score(true_code: Column, pred_code: Column, noise: Column, c: Column | int) -> Column:
    """Deterministic model score of class ``c`` for a sample (not normalised)."""
    c = F.lit(c) if isinstance(c, int) else c
    other = _dbl((c * 7 + true_code * 3 + noise) % 13) / D(40.0)
    return F.when(c == pred_code, D(0.5) + _dbl(noise) * D(0.04)).otherwise(other)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-predictions: the truth, or the next class when noise < 2."""
    s = samples(spark, sf_dir)
    pred_code = F.when(F.col("noise") < 2, (F.col("crop_code") + 1) % 22).otherwise(F.col("crop_code")).cast("int")
    return s.select(
        "sample_id", "N", "P", "K", "ph", "moisture", "noise", "state", "region",
        F.col("crop_code").alias("true_code"), pred_code.alias("pred_code"),
        F.col("crop").alias("true_label"), dims.crop_name(pred_code).alias("predicted_label"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts_us`` (epoch microseconds, time-zone independent) and ``ts`` as TIMESTAMP."""
    ev = spread(Tables(spark, sf_dir).read("events", "event_id", "ts", "user_id", "event_type", "value"))
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return ev.withColumn("ts_us", us).withColumn("ts", F.timestamp_micros(F.col("ts_us")))


def deficiency_label(n: Column, p: Column, k: Column) -> Column:
    return (F.when(n < 40.0, "Nitrogen deficient").when(p < 20.0, "Phosphorus deficient")
            .when(k < 30.0, "Potassium deficient").otherwise("Balanced"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field reading per event; the field is the user."""
    return telemetry_of(_events(spark, sf_dir))


def telemetry_of(ev: DataFrame) -> DataFrame:
    """The readings of events with ``ts`` and ``ts_us``, batch or stream."""
    eid = F.col("event_id")
    n = _dbl((eid * 11) % 150)
    p = _dbl((eid * 5) % 80)
    k = _dbl((eid * 3) % 90)
    return ev.select(
        F.col("user_id").alias("field_id"), "event_id", "ts", "ts_us",
        n.alias("N"), p.alias("P"), k.alias("K"),
        (D(4.0) + _dbl(eid % 50) / D(10.0)).alias("ph"),
        (D(10.0) + F.col("value") % D(33.0)).alias("temperature"),
        _dbl(D(20) + (eid * 7) % 76).alias("humidity"),
        _dbl((eid * 13) % 300).alias("rainfall"),
        dims.crop_name(((F.col("user_id") + eid) % 22).cast("int")).alias("crop_prediction"),
        deficiency_label(n, p, k).alias("deficiency"),
    )


def location_of(ev: DataFrame) -> DataFrame:
    uid, eid = F.col("user_id"), F.col("event_id")
    return ev.withColumns({
        "lat": D(8.0) + _dbl(uid % 5) * D(0.5) + _dbl(eid % 4) * D(0.001),
        "lon": D(76.0) + _dbl(uid % 3) * D(0.5) + _dbl(eid % 3) * D(0.001),
    })


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather observations: ``view`` events, located by user."""
    ev = location_of(_events(spark, sf_dir).filter(F.col("event_type") == "view"))
    eid, v = F.col("event_id"), F.col("value")
    return ev.select(
        eid.alias("obs_id"), "ts", "ts_us", "lat", "lon",
        (D(10.0) + v % D(33.0)).alias("temperature"),
        _dbl(D(15) + (eid * 7) % 80).alias("humidity"),
        (v % D(30.0)).alias("rainfall"),
        _dbl((eid * 3) % 40).alias("wind_speed"),
        _dbl((eid * 17) % 200).alias("precip_7d"),
        F.element_at(F.array(*[F.lit(c) for c, _ in dims.K.WEATHER_CODES] + [F.lit(42)]),
                     ((eid % 25) + 1).cast("int")).alias("weather_code"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference requests: ``purchase`` (served) and ``error`` (failed) events."""
    ev = location_of(_events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error")))
    eid, v, uid = F.col("event_id"), F.col("value"), F.col("user_id")
    return ev.select(
        eid.alias("req_id"), uid.alias("field_id"), "ts", "ts_us", "lat", "lon",
        (F.col("event_type") == "error").alias("is_error"),
        v.alias("latency_ms"),
        (D(12.0) + _dbl((eid * 5) % 30)).alias("temperature"),
        _dbl(D(25) + (eid * 3) % 70).alias("humidity"),
        _dbl((eid * 37) % 2000).alias("rainfall"),
        F.element_at(F.array(F.lit("rain-fed"), F.lit("canal irrigation"), F.lit("borewell"), F.lit("drip irrigation")),
                     ((uid % 4) + 1).cast("int")).alias("irrigation_type"),
        dims.crop_name(((uid * 3 + eid) % 22).cast("int")).alias("predicted_crop"),
    )


# --- geometry -------------------------------------------------------------
SQUARE = 8.0      # side of each nation's square
SPACING = 10.0    # grid pitch: squares leave 2-degree gaps


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square boundary per nation (outer ring, closed), in nation-key order.

    ``feature_order`` is the file order used for "first match wins".
    """
    nr = nation_region(Tables(spark, sf_dir))
    k = F.col("n_nationkey")
    x0 = _dbl(k % 5) * D(SPACING)
    y0 = _dbl(F.floor(k / 5)) * D(SPACING)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(pt(x0, y0), pt(x0 + D(SQUARE), y0), pt(x0 + D(SQUARE), y0 + D(SQUARE)),
                   pt(x0, y0 + D(SQUARE)), pt(x0, y0))
    return nr.select(k.alias("feature_order"), F.col("r_name").alias("state"),
                     F.col("n_name").alias("district"), ring.alias("ring"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One location per customer, spread over and around the squares."""
    c = Tables(spark, sf_dir).read("customer", "c_custkey")
    key = F.col("c_custkey")
    return c.select(key.alias("point_id"),
                    (_dbl((key * 7) % 600) / D(10.0) - D(2.0)).alias("lon"),
                    (_dbl((key * 11) % 560) / D(10.0) - D(1.0)).alias("lat"))


def hierarchy_levels(spark: SparkSession, sf_dir: str):
    """Administrative levels: state=region, district=nation, taluk=supplier, hobli=(supplier, part)."""
    t = Tables(spark, sf_dir)
    states = t.read("region", "r_regionkey", "r_name").toDF("id", "name")
    districts = t.read("nation", "n_nationkey", "n_regionkey", "n_name").toDF("id", "state_id", "name")
    taluks = t.read("supplier", "s_suppkey", "s_nationkey", "s_name").toDF("id", "district_id", "name")
    hoblis = (t.read("lineitem", "l_suppkey", "l_partkey").distinct()
              .select(F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("id"),
                      F.col("l_suppkey").alias("taluk_id"),
                      F.concat(F.lit("Hobli-"), F.col("l_partkey").cast("string")).alias("name")))
    return states, districts, taluks, hoblis


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).read("embeddings", "vec_id", "embedding", "label")


# --- decision inputs: one scoring request per sample ------------------------------------
IRRIGATION_TYPES = ["rain-fed", "canal irrigation", "borewell", "drip irrigation"]
SOIL_TEXTURES = ["clay", "loamy", "sandy", "black soil", "red soil", "clay loamy"]
AGRO_ZONES = ["coastal", "delta_region", "arid", "semi_arid", "dry_plains", "Delta Region", "Semi-Arid Plains"]
REGION_ZONES = ["coastal", "", "humid_coastal"]


def _pick(options, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx + 1).cast("int"))


def field_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as scoring requests with model outputs and field context.

    ``probs[c]`` is the normalised model score of class code ``c``; ``confidence`` is
    the predicted class's raw score (0.5-0.86).
    """
    s = samples(spark, sf_dir)
    code, noise = F.col("crop_code"), F.col("noise")
    s = s.withColumn("_pred", F.when(noise < 2, (code + 1) % 22).otherwise(code).cast("int"))
    pred = F.col("_pred")
    # one expression over the class codes: 22 written-out copies exceed what one generated method may hold
    s = s.withColumn("_scores", F.transform(F.array(*[F.lit(c) for c in range(22)]), lambda c: class_score(code, pred, noise, c)))
    return s.select(
        "sample_id", "N", "P", "K", "ph", "moisture", "temperature", "humidity", "rainfall", "state", "region",
        "crop", "noise", F.col("season").alias("seasonal_context"),
        dims.crop_name(pred).alias("predicted_crop"),
        class_score(code, pred, noise, pred).alias("confidence"),
        F.aggregate("_scores", F.lit(0.0), lambda total, x: total + x,
                    lambda total: F.transform("_scores", lambda x: x / total)).alias("probs"),   # indexed by class code
        _pick(["Low", "Medium", "High"], noise % 3).alias("fertility_pred"),
        deficiency_label(F.col("N"), F.col("P"), F.col("K")).alias("deficiency_pred"),
        _pick(IRRIGATION_TYPES, (code + noise) % 4).alias("irrigation_type"),
        _pick(SOIL_TEXTURES, code % 6).alias("soil_texture"),
        _pick(AGRO_ZONES, (code + noise) % 7).alias("agro_climatic_zone"),
        _pick(REGION_ZONES, noise % 3).alias("region_zone"),
        F.when(noise % 4 == 0, F.lit("Thanjavur")).when(noise % 4 == 1, F.lit("Coimbatore"))
         .otherwise(F.col("region")).alias("district"),
        F.when(noise % 5 == 0, F.concat(F.lit("Taluk-"), code.cast("string"))).alias("taluk"),
    )
