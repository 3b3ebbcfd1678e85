"""Time-based operators: weather as-of join and compatibility (S13, A25, J12, F13, R8, R9),
session history (W1, W3, W4), operations metrics (A24, W2), knowledge graph (J5, J6, R10)
and adaptive scoring (F10, F11, R11).

The as-of join never joins on the grid cell alone (a busy cell would meet all of its
observations): requests are matched on ``(cell, 30-minute bucket)`` for their own and
the previous bucket, which holds every observation within the TTL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features as FX
from ..functions.text import capitalize
from ..sources import dims
from ..sources import knowledge as K
from .scan import last_rows, ranked

TTL_US = K.WEATHER_TTL_SECONDS * 1_000_000

# --- S13 / A25 ---------------------------------------------------------------------------------
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("current", T.StructType([
        T.StructField("temperature_2m", T.DoubleType()), T.StructField("relative_humidity_2m", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()), T.StructField("wind_speed_10m", T.DoubleType()),
        T.StructField("weather_code", T.IntegerType())])),
    T.StructField("daily", T.StructType([
        T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
        T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType()))])),
])


def _mean(arr: Column, default: Column) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, total / F.size(arr)).otherwise(default)


def normalize_forecast(payload_json: Column) -> Column:
    """Parse a forecast payload and normalise it (defaults, means, sums, code text)."""
    p = F.from_json(payload_json, PAYLOAD_SCHEMA)
    cur, daily = p["current"], p["daily"]
    t = F.coalesce(cur["temperature_2m"], F.lit(25.0))
    code = F.coalesce(cur["weather_code"], F.lit(0))
    codes = dims.literal_map(K.WEATHER_CODES)
    precip = daily["precipitation_sum"]
    psum = F.when(F.coalesce(F.size(precip), F.lit(0)) > 0, F.aggregate(precip, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    return F.struct(
        F.lit("success").alias("status"), t.alias("temperature"),
        F.coalesce(cur["relative_humidity_2m"], F.lit(50.0)).alias("humidity"),
        F.coalesce(cur["precipitation"], F.lit(0.0)).alias("rainfall"),
        F.coalesce(cur["wind_speed_10m"], F.lit(0.0)).alias("wind_speed"),
        F.coalesce(codes[code], F.lit("Unknown")).alias("weather_condition"),
        F.struct(F.round(_mean(daily["temperature_2m_max"], t), 1).alias("avg_temp_max"),
                 F.round(_mean(daily["temperature_2m_min"], t), 1).alias("avg_temp_min"),
                 F.round(psum, 1).alias("predicted_precipitation_sum_7d")).alias("forecast"))


def payload_from_observation(obs: DataFrame) -> DataFrame:
    """The JSON payload a forecast service would return for an observation (input for S13)."""
    oid = F.col("obs_id")
    daily = lambda f: F.array(*[f(i) for i in range(7)])
    tmax = daily(lambda i: (F.lit(20) + (oid * 3 + i) % 15).cast("double") + F.lit(0.3 * i))
    tmin = daily(lambda i: (F.lit(8) + (oid + i * 2) % 11).cast("double") + F.lit(0.1 * i))
    prec = daily(lambda i: ((oid + i) % 10).cast("double") * F.lit(1.5))
    payload = F.struct(
        F.struct(F.col("temperature").alias("temperature_2m"), F.col("humidity").alias("relative_humidity_2m"),
                 F.col("rainfall").alias("precipitation"), F.col("wind_speed").alias("wind_speed_10m"),
                 F.col("weather_code").alias("weather_code")).alias("current"),
        F.struct(tmax.alias("temperature_2m_max"), tmin.alias("temperature_2m_min"), prec.alias("precipitation_sum")).alias("daily"))
    return obs.select("obs_id", "lat", "lon", "ts_us", F.to_json(payload).alias("payload"))


# --- J12 ----------------------------------------------------------------------------------------
ASOF_CHUNKS = 30   # parts of a ttl; one task reads the rows of a cell in one part


def asof_weather(requests: DataFrame, observations: DataFrame, ttl_us: int = TTL_US) -> DataFrame:
    """Each request gets the latest observation of its grid cell at most ``ttl`` old (ties: largest ``obs_id``).

    No pairs are formed: requests and observations of a (cell, chunk) are read in time order and the last
    observation is kept; a request that has none in its chunk takes the last one of the earlier chunks of its
    ttl-wide bucket, else that of the previous bucket.  Requests without an observation keep nulls; those
    without a time or a position meet none.
    """
    placed = observations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("ts_us").isNotNull())
    obs = placed.select(
        FX.grid_key().alias("cell"), F.col("ts_us").alias("_ts"),
        F.struct("obs_id", F.col("ts_us").alias("obs_ts_us"), F.col("temperature").alias("live_temp"),
                 F.col("humidity").alias("live_hum"), F.col("rainfall").alias("live_rain"), "wind_speed",
                 F.col("precip_7d").alias("precip_7d")).alias("obs"))
    req = requests.select(FX.grid_key().alias("cell"), F.col("ts_us").alias("_ts"),
                          F.struct(*[c for c in requests.columns if c != "cell"]).alias("r"))
    rows = obs.unionByName(req, allowMissingColumns=True).withColumns(
        {"_bucket": F.floor(F.col("_ts") / ttl_us), "_chunk": F.floor(F.col("_ts") * ASOF_CHUNKS / ttl_us)})
    bucket, chunk = ["cell", "_bucket"], ["cell", "_bucket", "_chunk"]
    age = lambda o: F.when(F.col(o).isNotNull(), F.struct(F.col(o)["obs_ts_us"], F.col(o)["obs_id"]))
    in_chunk = (Window.partitionBy(*chunk).orderBy("_ts", F.col("r").isNotNull(), F.col("obs.obs_id"))
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = rows.withColumn("_own", F.last("obs", ignorenulls=True).over(in_chunk)).filter(F.col("r").isNotNull())
    last = rows.groupBy(*chunk).agg(F.max_by("obs", age("obs")).alias("_last"))
    earlier = Window.partitionBy(*bucket).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*chunk, F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    previous = last.groupBy(*bucket).agg(F.max_by("_last", age("_last")).alias("_previous")).withColumn("_bucket", F.col("_bucket") + 1)
    found = F.coalesce("_own", "_before", "_previous")
    return own.join(before, chunk, "left").join(previous, bucket, "left").select(
        "r.*", "cell", F.when(found["obs_ts_us"] >= F.col("_ts") - ttl_us, found).alias("obs"))


# --- R8 / R9 ------------------------------------------------------------------------------------
def compatibility(user_temp: Column, user_hum: Column, user_rain: Column, irrigation: Column, obs: Column) -> Column:
    """Alignment, tier, risk levels, badges and narratives; fallback record without weather."""
    lt, lh, lr = obs["live_temp"], obs["live_hum"], obs["live_rain"]
    wind, p7 = F.coalesce(obs["wind_speed"], F.lit(0.0)), F.coalesce(obs["precip_7d"], F.lit(0.0))
    irr = F.lower(F.coalesce(irrigation, F.lit("rain-fed")))
    ut, uh, ur = F.coalesce(user_temp, lt), F.coalesce(user_hum, lh), F.coalesce(user_rain, lr)
    align = FX.alignment_score(ut, lt, uh, lh)
    tier = FX.alignment_tier(align)
    drought = F.when((lt > 35.0) & (lh < 30.0), "High").when((lt > 30.0) & (lh < 45.0), "Medium").otherwise("Low")
    water = F.when(drought == "High", "High").when(drought == "Medium", "Medium").otherwise("Low")
    water = F.when((irr == "rain-fed") & (drought != "Low"), "High").otherwise(water)
    flood = F.when((lr > 20.0) | (p7 > 120.0), "High").when((lr > 5.0) | (p7 > 60.0), "Medium").otherwise("Low")
    heat = F.when(lt > 40.0, "High").when(lt > 34.0, "Medium").otherwise("Low")
    badge = F.when(lh > 75.0, "Humid/Wet Zone").when(lh < 40.0, "Dry/Arid Zone").otherwise("Optimal Vapor Profile")
    warn = F.array_compact(F.array(
        F.when(tier == "CRITICAL ANOMALY", F.lit("User inputs differ significantly from current local environmental conditions.")),
        F.when(F.abs(ut - lt) > 12.0, F.format_string("Temperature anomaly: Local sensors read %.1f°C but manual input is %.1f°C.", lt, ut)),
        F.when(F.abs(uh - lh) > 35.0, F.format_string("Humidity divergence: Local relative humidity is %.1f%% vs manual %.1f%%.", lh, uh)),
        F.when((ur > 1200.0) & (p7 < 10.0) & (lr == 0), F.lit(
            "Water budget mismatch: Heavy rain context specified but local forecast is dry (<10mm next 7 days)."))))
    live = F.struct(align.alias("alignment_score"), tier.alias("realism_confidence"), drought.alias("drought_risk"),
                    flood.alias("flood_sensitivity"), heat.alias("heat_stress"), water.alias("water_stress"),
                    badge.alias("climate_badge"), warn.alias("consistency_warnings"))
    fallback = F.struct(F.lit(100).alias("alignment_score"), F.lit("HIGH (Fallback Mode)").alias("realism_confidence"),
                        F.lit("Low").alias("drought_risk"), F.lit("Low").alias("flood_sensitivity"),
                        F.lit("Low").alias("heat_stress"), F.lit("Low").alias("water_stress"),
                        F.lit("Sensor Normal").alias("climate_badge"),
                        F.array(F.lit("Live weather API temporarily offline. Standing by on manual entries.")).alias("consistency_warnings"))
    return F.when(obs.isNull(), fallback).otherwise(live)


def weather_context(df: DataFrame) -> DataFrame:
    """Status (success / fallback / error for bad coordinates) and the R8 record."""
    ok = FX.valid_coordinates("lat", "lon")
    status = F.when(~ok, "error").when(F.col("obs").isNull(), "fallback").otherwise("success")
    obs = F.when(ok, F.col("obs"))
    comp = compatibility(F.col("temperature"), F.col("humidity"), F.col("rainfall"), F.col("irrigation_type"), obs)
    return df.withColumn("status", status).withColumn("compat", comp)


# --- W1 / W3 / W4 --------------------------------------------------------------------------------
HIST_FIELDS = ["N", "P", "K", "temperature", "humidity", "rainfall", "crop_prediction", "deficiency"]


def session_history(telemetry: DataFrame, n: int = K.HISTORY_CAPACITY, include_current: bool = True) -> DataFrame:
    """The field's last ``n`` entries (ordered by time, event id) as an array column ``history``.

    ``include_current=False`` gives the entries *before* this one (as read by R11).  Entries are ranked by an
    ordered scan and framed in chunks of ranks: a busy field, or one with a million entries in a minute, is many tasks.
    """
    size = n if include_current else n + 1
    entry = F.struct("ts_us", "event_id", *HIST_FIELDS)
    in_order = ranked(telemetry, ["field_id"], [F.col("ts_us"), F.col("event_id")], "_rank", "history")
    h = last_rows(in_order, ["field_id"], "_rank", size, {"history": F.collect_list(entry)}).drop("_rank")
    if not include_current:
        h = h.withColumn("history", F.slice("history", 1, F.size("history") - 1))
    return h


def drift(history: Column) -> Column:
    """Last - first temperature, drought trend, rainfall trend; neutral below 2 entries."""
    first, last = history[0], F.element_at(history, -1)
    enough = F.size(history) >= 2
    d = last["temperature"] - first["temperature"]
    rain = F.when(last["rainfall"] < first["rainfall"] - 50.0, "drying").when(
        last["rainfall"] > first["rainfall"] + 50.0, "wetting").otherwise("stable")
    return F.struct(F.when(enough, (d > 2.0) & (last["humidity"] < first["humidity"])).otherwise(False).alias("drought_trend"),
                    F.when(enough, rain).otherwise("stable").alias("rainfall_trend"),
                    F.when(enough, d).otherwise(0.0).alias("temp_drift"))


def recurring_deficiencies(history: Column) -> Column:
    """Nutrients deficient in at least two history entries (sorted); balanced/healthy excluded.

    Labels are normalised to the nutrient ("Nitrogen deficient" -> "Nitrogen").
    """
    labels = F.transform(F.filter(history, lambda e: F.coalesce(e["deficiency"], F.lit("")) != ""),
                         lambda e: F.lower(F.split(e["deficiency"], " ")[0]))
    rec = F.filter(F.array_distinct(labels), lambda x: (F.size(F.filter(labels, lambda y: y == x)) >= 2)
                   & ~x.isin("healthy", "balanced"))
    return F.when(F.size(history) < 2, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.transform(rec, lambda x: capitalize(x))))


# --- A24 / W2 -----------------------------------------------------------------------------------
def moving_latency(requests: DataFrame, n: int = K.LATENCY_WINDOW) -> DataFrame:
    """Mean latency of the last ``n`` requests of all fields (by time, request id).  Global ranks come from block
    totals and the frames lie in chunks of ranks, so there is no global window and no carry in one task."""
    in_order = ranked(requests, [], [F.col("ts_us"), F.col("req_id")], "_rank", "latency")
    return last_rows(in_order, [], "_rank", n, {"moving_avg_latency": F.avg("latency_ms")}).drop("_rank")


def operations_snapshot(requests: DataFrame, weather: DataFrame, last: int = K.LATENCY_WINDOW) -> DataFrame:
    """Totals, error %, mean latency of the ``last`` requests, cache-hit ratio (requests served from a cached observation)."""
    hits = F.count_if(F.col("obs").isNotNull())
    recent = requests.orderBy(F.desc("ts_us"), F.desc("req_id")).limit(last).agg(F.round(F.avg("latency_ms"), 2).alias("average_latency_ms"))
    return weather.agg(
        F.count("*").alias("total_requests"), F.count_if("is_error").alias("total_errors"),
        F.round(F.count_if("is_error") / F.greatest(F.count("*"), F.lit(1)) * 100.0, 2).alias("error_rate_percent"),
        F.round(hits / F.greatest(F.count("*"), F.lit(1)), 2).alias("cache_hit_ratio")).join(F.broadcast(recent))   # one row each


# --- J5 / J6 / R10: knowledge graph -------------------------------------------------------------------
def _bidir_match(value: Column, prefs) -> Column:
    """``pref in value or value in pref`` against a literal list."""
    return F.exists(F.array(*[F.lit(p.lower()) for p in prefs]), lambda p: F.contains(value, p) | F.contains(p, value))


def graph_compatibility(crop: Column, soil: Column, zone: Column, irrigation: Column, n: Column) -> Column:
    """Score offset, matching/conflicting counts, sustainability bonus (J5 lookup per crop node).

    Unknown crops give the neutral result (offset 0, bonus 0).
    """
    c = F.lower(crop)
    soil_l, zone_l, irr_l = (F.lower(F.coalesce(x, F.lit(""))) for x in (soil, zone, irrigation))
    nv = F.coalesce(n, F.lit(50.0))
    offset, bonus, matches, conflicts = F.lit(0), F.lit(0), F.lit(0), F.lit(0)
    for (name, _h, soils, _s, (dn, _dp, _dk), irrs, zones, sust, _f, fixer, _w) in K.GRAPH_NODES:
        hit = c == name
        o = F.lit(0)
        mt = F.lit(0)
        cf = F.lit(0)
        for val, prefs, plus, minus in ((soil_l, soils, 15, -10), (zone_l, zones, 10, -5), (irr_l, irrs, 10, -10)):
            present = val != ""
            m = _bidir_match(val, prefs)
            o = o + F.when(present & m, plus).when(present, minus).otherwise(0)
            mt = mt + F.when(present & m, 1).otherwise(0)
            cf = cf + F.when(present & ~m, 1).otherwise(0)
        if fixer:
            nrule = F.when(nv < K.GRAPH_N_LOW, 20).otherwise(0)
            nm = F.when(nv < K.GRAPH_N_LOW, 1).otherwise(0)
            nc = F.lit(0)
        elif dn == "high":
            nrule = F.when(nv < K.GRAPH_N_LOW, -15).when(nv > K.GRAPH_N_HIGH, 10).otherwise(0)
            nm = F.when(nv > K.GRAPH_N_HIGH, 1).otherwise(0)
            nc = F.when(nv < K.GRAPH_N_LOW, 1).otherwise(0)
        else:
            nrule, nm, nc = F.lit(0), F.lit(0), F.lit(0)
        offset = F.when(hit, o + nrule).otherwise(offset)
        matches = F.when(hit, mt + nm).otherwise(matches)
        conflicts = F.when(hit, cf + nc).otherwise(conflicts)
        bonus = F.when(hit, F.lit(int(sust / 10))).otherwise(bonus)
    return F.struct(offset.alias("score_offset"), matches.alias("matching"), conflicts.alias("conflicting"),
                    bonus.alias("sustainability_bonus"))


def water_intensity(crop: Column) -> Column:
    m = dims.literal_map([(name, w) for (name, *_rest, w) in K.GRAPH_NODES if w])
    return m[F.lower(crop)]


def adaptive_score(df: DataFrame, conf: str = "confidence_pct") -> DataFrame:
    """Risk penalties, drying-drift penalty for extreme water crops, recovery urgency, F10, F11.

    Expects ``compat`` (R8), ``drift_prev`` (W3 over the earlier entries), ``recurring`` (W4),
    ``graph`` (R10) and the telemetry columns.
    """
    cp = F.col("compat")
    pen = (F.when(cp["drought_risk"] == "High", 15.0).when(cp["drought_risk"] == "Medium", 5.0).otherwise(0.0)
           + F.when(cp["flood_sensitivity"] == "High", 10.0).when(cp["flood_sensitivity"] == "Medium", 3.0).otherwise(0.0)
           + F.when(cp["heat_stress"] == "High", 10.0).otherwise(0.0))
    drying = (water_intensity(F.col("crop_prediction")) == "extreme") & (
        F.col("drift_prev.drought_trend") | (F.col("drift_prev.rainfall_trend") == "drying"))
    pen = pen + F.when(F.coalesce(drying, F.lit(False)), 20.0).otherwise(0.0)
    urgency = F.when(F.exists("recurring", lambda g: F.lower(g).isin("nitrogen", "potassium")), "CRITICAL RECOVERY") \
        .otherwise("standard")
    graph = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(50) + F.col("graph.score_offset")
                                         + F.col("graph.sustainability_bonus") * 4))
    soil = FX.soil_health_rating()
    out = df.withColumns({"risk_penalties": pen, "soil_rebuild_urgency": urgency, "kg_score": graph,
                          "soil_health_rating": soil, "env_alignment": cp["alignment_score"].cast("double")})
    return out.withColumn("intelligence_score", FX.intelligence_score(conf, "env_alignment", "kg_score",
                                                                      "soil_health_rating", "risk_penalties"))
