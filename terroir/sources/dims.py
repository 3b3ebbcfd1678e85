"""Small dimension tables and literal expressions built from the fixed knowledge values.

All of these have a size fixed by the rule set (22 crop profiles, 7 graph nodes, 24
weather codes, ...), independent of the data volume, which is what makes
broadcasting them - or inlining them as literal arrays/maps - safe at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import knowledge as K

PROFILE_SCHEMA = T.StructType([
    T.StructField("crop", T.StringType()),
    T.StructField("profile_order", T.IntegerType()),
    T.StructField("rain_lo", T.DoubleType()), T.StructField("rain_hi", T.DoubleType()),
    T.StructField("temp_lo", T.DoubleType()), T.StructField("temp_hi", T.DoubleType()),
    T.StructField("hum_lo", T.DoubleType()), T.StructField("hum_hi", T.DoubleType()),
    T.StructField("ph_lo", T.DoubleType()), T.StructField("ph_hi", T.DoubleType()),
    T.StructField("seasons", T.ArrayType(T.StringType())),
    T.StructField("duration", T.StringType()),
])


def _num(v) -> str:
    """Python ``str`` of a profile bound, as it is printed in rule texts (1200, 5.0)."""
    return str(v)


def profile_rows():
    for i, (crop, rl, rh, tl, th, hl, hh, pl, ph, seasons, dur) in enumerate(K.CROP_PROFILES):
        yield (crop, i, float(rl), float(rh), float(tl), float(th), float(hl), float(hh),
               float(pl), float(ph), list(seasons), dur)


def crop_profiles(spark: SparkSession) -> DataFrame:
    """The 22 crop profiles as a DataFrame (fixed size: safe to broadcast)."""
    return spark.createDataFrame(list(profile_rows()), PROFILE_SCHEMA)


def profile_struct_list() -> list:
    """One literal struct per profile (bounds, seasons, class index, bound texts)."""
    from . import knowledge as K
    items = []
    for (crop, i, rl, rh, tl, th, hl, hh, pl, ph, seasons, dur) in profile_rows():
        src = K.CROP_PROFILES[i]
        items.append(F.struct(
            F.lit(crop).alias("crop"), F.lit(i).alias("profile_order"),
            F.lit(K.CROP_CLASSES.index(crop)).alias("class_idx"),
            F.lit(rl).alias("rain_lo"), F.lit(rh).alias("rain_hi"),
            F.lit(tl).alias("temp_lo"), F.lit(th).alias("temp_hi"),
            F.lit(hl).alias("hum_lo"), F.lit(hh).alias("hum_hi"),
            F.lit(pl).alias("ph_lo"), F.lit(ph).alias("ph_hi"),
            F.array(*[F.lit(s) for s in seasons]).alias("seasons"),
            F.lit("perennial" in seasons).alias("perennial"),
            F.lit(_num(src[1])).alias("rain_lo_txt"), F.lit(_num(src[2])).alias("rain_hi_txt"),
            F.lit(_num(src[3])).alias("temp_lo_txt"), F.lit(_num(src[4])).alias("temp_hi_txt"),
            F.lit(_num(src[7])).alias("ph_lo_txt"), F.lit(_num(src[8])).alias("ph_hi_txt"),
        ))
    return items


def profile_structs() -> Column:
    """The 22 profiles as one literal ``array<struct>`` column, in profile order.

    Exploding it gives one row per (sample, profile) without a join (a Generate step).
    """
    return F.array(*profile_struct_list())


def crop_class_array() -> Column:
    return F.array(*[F.lit(c) for c in K.CROP_CLASSES])


def crop_name(code: Column) -> Column:
    """Class code (0-based) -> crop name, via a literal array."""
    return F.element_at(crop_class_array(), code + F.lit(1))


def literal_map(pairs) -> Column:
    """A ``map`` literal from (key, value) pairs."""
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def weather_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.WEATHER_CODES, "code int, condition string")


def graph_nodes(spark: SparkSession) -> DataFrame:
    rows = []
    for (crop, hum, soils, sens, (dn, dp, dk), irr, zones, sust, factors, fixer, water) in K.GRAPH_NODES:
        rows.append((crop, hum, soils, sens, {"N": dn, "P": dp, "K": dk}, irr, zones, sust, factors, fixer, water))
    schema = ("crop string, requires_humidity string, prefers_soil array<string>, sensitive_to array<string>, "
              "demands map<string,string>, irrigation_preference array<string>, agro_climatic_zones array<string>, "
              "sustainability_score int, sustainability_factors array<string>, nitrogen_fixer boolean, "
              "water_intensity string")
    return spark.createDataFrame(rows, schema)


def graph_edges(spark: SparkSession) -> DataFrame:
    """Node attributes as a ``(crop, relation, value)`` edge table."""
    rows = []
    for (crop, hum, soils, sens, (dn, dp, dk), irr, zones, sust, factors, fixer, water) in K.GRAPH_NODES:
        rows.append((crop, "requires_humidity", hum))
        rows += [(crop, "prefers_soil", s) for s in soils]
        rows += [(crop, "sensitive_to", s) for s in sens]
        rows += [(crop, "demands_N", dn), (crop, "demands_P", dp), (crop, "demands_K", dk)]
        rows += [(crop, "irrigation_preference", s) for s in irr]
        rows += [(crop, "agro_climatic_zone", s) for s in zones]
    return spark.createDataFrame(rows, "crop string, relation string, value string")


def season_calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SEASON_CALENDAR, "crop string, season string, advice string")


def crop_guides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.CROP_GUIDES.items()), "crop string, guide string")


def fertilizer_by_deficiency(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.FERTILIZER_BY_DEFICIENCY.items()), "deficiency string, fertilizer string")


def district_profiles(spark: SparkSession) -> DataFrame:
    rows = [(d,) + tuple(v[:7]) + (list(v[7]),) for d, v in K.DISTRICT_PROFILES.items()]
    return spark.createDataFrame(rows, "district string, zone string, rainfall_zone string, drought_sensitivity string, "
                                       "humidity_profile string, irrigation_dependency string, salinity_risk string, "
                                       "flood_sensitivity string, crop_tendencies array<string>")
