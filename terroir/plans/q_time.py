"""Time, weather, session and knowledge-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..functions.text import checksum
from ..operators import timeops as TO
from ..sources import knowledge as K
from ..sources import proxies as P
from . import sqltext as S
from .catalog import register
from .oracle_views import with_views

R6 = lambda c: F.round(c, 6)
TTL = K.WEATHER_TTL_SECONDS * 1_000_000


def _cell_sql(lat="lat", lon="lon"):
    r2 = lambda x: f"cast(cast(round(cast(cast({x} as varchar) as decimal(38, 10)), 2) as decimal(38, 2)) as varchar)"
    return f"concat({r2(lat)}, '_', {r2(lon)})"


# --- S13 / A25 -------------------------------------------------------------------------------------
def _avg_sql(term):
    return "(" + " + ".join(["cast(0 as double)"] + [term(i) for i in range(7)]) + f") / cast(7 as double)"


_TMAX = lambda i: f"(cast(20 + (obs_id * 3 + {i}) % 15 as double) + cast({repr(0.3 * i)} as double))"
_TMIN = lambda i: f"(cast(8 + (obs_id + {i * 2}) % 11 as double) + cast({repr(0.1 * i)} as double))"
_PREC = lambda i: f"(cast((obs_id + {i}) % 10 as double) * cast(1.5 as double))"
_CODES_SQL = "CASE weather_code " + " ".join(f"WHEN {c} THEN {S.q(t)}" for c, t in K.WEATHER_CODES) + " ELSE 'Unknown' END"
_FORECAST_SQL = f"""
fc AS (SELECT obs_id, lat, lon, temperature, humidity, rainfall, wind_speed, {_CODES_SQL} AS weather_condition,
              round({_avg_sql(_TMAX)}, 1) AS avg_temp_max, round({_avg_sql(_TMIN)}, 1) AS avg_temp_min,
              round({' + '.join(['cast(0 as double)'] + [_PREC(i) for i in range(7)])}, 1) AS precip_sum_7d
       FROM observations)"""


def _forecast(spark, sf):
    obs = P.observations(spark, sf)
    pay = TO.payload_from_observation(obs)
    n = pay.select("obs_id", "lat", "lon", TO.normalize_forecast(F.col("payload")).alias("w"))
    return n.select("obs_id", "lat", "lon", "w.temperature", "w.humidity", "w.rainfall", "w.wind_speed",
                    "w.weather_condition", F.col("w.forecast.avg_temp_max").alias("avg_temp_max"),
                    F.col("w.forecast.avg_temp_min").alias("avg_temp_min"),
                    F.col("w.forecast.predicted_precipitation_sum_7d").alias("precip_sum_7d"))


@register("s13_forecast_normalize", with_views(f"""
WITH {_FORECAST_SQL}
SELECT obs_id, temperature, humidity, rainfall, wind_speed, weather_condition, avg_temp_max, avg_temp_min, precip_sum_7d
FROM fc""", "observations"))
def s13_forecast_normalize(spark, sf):
    return _forecast(spark, sf).drop("lat", "lon")


@register("a25_forecast_by_cell", with_views(f"""
WITH {_FORECAST_SQL}
SELECT {_cell_sql()} AS cell, count(*) AS n, round(avg(avg_temp_max), 6) AS mean_temp_max,
       round(sum(precip_sum_7d), 6) AS total_precip FROM fc GROUP BY 1""", "observations"))
def a25_forecast_by_cell(spark, sf):
    f = _forecast(spark, sf)
    return f.groupBy(FX.grid_key().alias("cell")).agg(F.count("*").alias("n"), R6(F.avg("avg_temp_max")).alias("mean_temp_max"),
                                                      R6(F.sum("precip_sum_7d")).alias("total_precip"))


# --- J12 / R8 / R9 ------------------------------------------------------------------------------------
_ASOF_SQL = f"""
rq AS (SELECT *, {_cell_sql()} AS cell FROM requests),
ob AS (SELECT *, {_cell_sql()} AS cell FROM observations),
m AS (SELECT rq.req_id, ob.obs_id, ob.ts_us AS obs_ts, ob.temperature AS live_temp, ob.humidity AS live_hum,
             ob.rainfall AS live_rain, ob.wind_speed, ob.precip_7d,
             row_number() OVER (PARTITION BY rq.req_id ORDER BY ob.ts_us DESC, ob.obs_id DESC) AS rn
      FROM rq JOIN ob ON rq.cell = ob.cell AND ob.ts_us <= rq.ts_us AND ob.ts_us >= rq.ts_us - {TTL}),
aw AS (SELECT rq.*, m.obs_id, m.live_temp, m.live_hum, m.live_rain, m.wind_speed, m.precip_7d
       FROM rq LEFT JOIN m ON rq.req_id = m.req_id AND m.rn = 1)"""


def _asof(spark, sf):
    return TO.asof_weather(P.requests(spark, sf), P.observations(spark, sf))


@register("j12_asof_weather", with_views(f"""
WITH {_ASOF_SQL}
SELECT req_id, cell, obs_id FROM aw""", "requests", "observations"))
def j12_asof_weather(spark, sf):
    return _asof(spark, sf).select("req_id", "cell", F.col("obs.obs_id").alias("obs_id"))


def _compat_sql():
    ut, uh, ur = "temperature", "humidity", "rainfall"
    align = f"least(100, greatest(5, trunc(cast(100 as double) - abs({ut} - live_temp) * 4.5 - abs({uh} - live_hum) * 1.2)::int))"
    warn = S.compact(
        f"CASE WHEN {align} < 50 THEN 'User inputs differ significantly from current local environmental conditions.' END",
        f"CASE WHEN abs({ut} - live_temp) > 12.0 THEN concat('Temperature anomaly: Local sensors read ', {S.fmt1('live_temp')}, '°C but manual input is ', {S.fmt1(ut)}, '°C.') END",
        f"CASE WHEN abs({uh} - live_hum) > 35.0 THEN concat('Humidity divergence: Local relative humidity is ', {S.fmt1('live_hum')}, '% vs manual ', {S.fmt1(uh)}, '%.') END",
        f"CASE WHEN {ur} > 1200.0 AND coalesce(precip_7d, 0) < 10.0 AND live_rain = 0 THEN 'Water budget mismatch: Heavy rain context specified but local forecast is dry (<10mm next 7 days).' END")
    drought = "CASE WHEN live_temp > 35.0 AND live_hum < 30.0 THEN 'High' WHEN live_temp > 30.0 AND live_hum < 45.0 THEN 'Medium' ELSE 'Low' END"
    return f"""
c AS (SELECT req_id, obs_id IS NULL AS fb,
        CASE WHEN obs_id IS NULL THEN 100 ELSE {align} END AS alignment_score,
        CASE WHEN obs_id IS NULL THEN 'HIGH (Fallback Mode)' WHEN {align} >= 80 THEN 'HIGH CONSISTENCY'
             WHEN {align} >= 50 THEN 'MODERATE DIVERGENCE' ELSE 'CRITICAL ANOMALY' END AS realism_confidence,
        CASE WHEN obs_id IS NULL THEN 'Low' ELSE {drought} END AS drought_risk,
        CASE WHEN obs_id IS NULL THEN 'Low' WHEN live_rain > 20.0 OR coalesce(precip_7d, 0) > 120.0 THEN 'High'
             WHEN live_rain > 5.0 OR coalesce(precip_7d, 0) > 60.0 THEN 'Medium' ELSE 'Low' END AS flood_sensitivity,
        CASE WHEN obs_id IS NULL THEN 'Low' WHEN live_temp > 40.0 THEN 'High' WHEN live_temp > 34.0 THEN 'Medium' ELSE 'Low' END AS heat_stress,
        CASE WHEN obs_id IS NULL THEN 'Low' WHEN lower(coalesce(irrigation_type, 'rain-fed')) = 'rain-fed' AND {drought} <> 'Low' THEN 'High'
             ELSE {drought} END AS water_stress,
        CASE WHEN obs_id IS NULL THEN 'Sensor Normal' WHEN live_hum > 75.0 THEN 'Humid/Wet Zone' WHEN live_hum < 40.0 THEN 'Dry/Arid Zone'
             ELSE 'Optimal Vapor Profile' END AS climate_badge,
        CASE WHEN obs_id IS NULL THEN 'Live weather API temporarily offline. Standing by on manual entries.'
             ELSE array_to_string({warn}, ' | ') END AS warnings
      FROM aw)"""


@register("r08_compatibility", with_views(f"""
WITH {_ASOF_SQL}, {_compat_sql()}
SELECT req_id, alignment_score, realism_confidence, drought_risk, flood_sensitivity, heat_stress, water_stress, climate_badge,
       {S.ck('warnings')} AS warnings_ck FROM c""", "requests", "observations"))
def r08_compatibility(spark, sf):
    w = TO.weather_context(_asof(spark, sf))
    c = F.col("compat")
    return w.select("req_id", c["alignment_score"].alias("alignment_score"), c["realism_confidence"].alias("realism_confidence"),
                    c["drought_risk"].alias("drought_risk"), c["flood_sensitivity"].alias("flood_sensitivity"),
                    c["heat_stress"].alias("heat_stress"), c["water_stress"].alias("water_stress"),
                    c["climate_badge"].alias("climate_badge"),
                    checksum(F.array_join(c["consistency_warnings"], " | ")).alias("warnings_ck"))


@register("r09_weather_context", with_views(f"""
WITH {_ASOF_SQL}
SELECT CASE WHEN NOT coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) THEN 'error'
            WHEN obs_id IS NULL THEN 'fallback' ELSE 'success' END AS status, count(*) AS n FROM aw GROUP BY 1""",
                                            "requests", "observations"))
def r09_weather_context(spark, sf):
    return TO.weather_context(_asof(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


# --- A24 / W2 --------------------------------------------------------------------------------------------
@register("a24_operations_snapshot", with_views(f"""
WITH {_ASOF_SQL}
SELECT count(*) AS total_requests, count_if(is_error) AS total_errors,
       round(count_if(is_error) / greatest(count(*), 1) * 100.0, 2) AS error_rate_percent,
       (SELECT round(avg(latency_ms), 2) FROM (SELECT latency_ms FROM requests ORDER BY ts_us DESC, req_id DESC LIMIT 100)) AS average_latency_ms,
       round(count_if(obs_id IS NOT NULL) / greatest(count(*), 1), 2) AS cache_hit_ratio FROM aw""",
                                                "requests", "observations"))
def a24_operations_snapshot(spark, sf):
    return TO.operations_snapshot(P.requests(spark, sf), _asof(spark, sf))


@register("a24_prediction_counts", with_views("""
SELECT predicted_crop, count(*) AS n FROM requests WHERE NOT is_error GROUP BY 1""", "requests"))
def a24_prediction_counts(spark, sf):
    return P.requests(spark, sf).filter(~F.col("is_error")).groupBy("predicted_crop").agg(F.count("*").alias("n"))


@register("w02_moving_latency", with_views("""
SELECT req_id, round(avg(latency_ms) OVER (ORDER BY ts_us, req_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS moving_avg_latency
FROM requests""", "requests"))
def w02_moving_latency(spark, sf):
    return TO.moving_latency(P.requests(spark, sf)).select("req_id", R6(F.col("moving_avg_latency")).alias("moving_avg_latency"))


# --- W1 / W3 / W4 ------------------------------------------------------------------------------------------
_W = "OVER (PARTITION BY field_id ORDER BY ts_us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@register("w01_session_history", with_views(f"""
SELECT event_id, count(*) {_W} AS hist_len, first_value(event_id) {_W} AS first_event,
       round(avg(temperature) {_W}, 6) AS avg_temperature FROM telemetry""", "telemetry"))
def w01_session_history(spark, sf):
    h = TO.session_history(P.telemetry(spark, sf))
    temps = F.transform("history", lambda e: e["temperature"])
    return h.select("event_id", F.size("history").cast("bigint").alias("hist_len"),
                    F.col("history")[0]["event_id"].alias("first_event"),
                    R6(F.aggregate(temps, F.lit(0.0), lambda a, x: a + x) / F.size(temps)).alias("avg_temperature"))


@register("w03_environmental_drift", with_views(f"""
WITH w AS (SELECT event_id, count(*) {_W} AS k, first_value(temperature) {_W} AS t0, temperature AS t1,
                  first_value(humidity) {_W} AS h0, humidity AS h1, first_value(rainfall) {_W} AS r0, rainfall AS r1 FROM telemetry)
SELECT event_id, CASE WHEN k >= 2 THEN (t1 - t0 > 2.0 AND h1 < h0) ELSE false END AS drought_trend,
       CASE WHEN k < 2 THEN 'stable' WHEN r1 < r0 - 50.0 THEN 'drying' WHEN r1 > r0 + 50.0 THEN 'wetting' ELSE 'stable' END AS rainfall_trend,
       round(CASE WHEN k >= 2 THEN t1 - t0 ELSE 0.0 END, 6) AS temp_drift FROM w""", "telemetry"))
def w03_environmental_drift(spark, sf):
    h = TO.session_history(P.telemetry(spark, sf))
    d = TO.drift(F.col("history"))
    return h.select("event_id", d["drought_trend"].alias("drought_trend"), d["rainfall_trend"].alias("rainfall_trend"),
                    R6(d["temp_drift"]).alias("temp_drift"))


@register("w04_recurring_deficiency", with_views(f"""
WITH w AS (SELECT event_id, count(*) {_W} AS k, list(lower(split_part(deficiency, ' ', 1))) {_W} AS l FROM telemetry)
SELECT event_id, CASE WHEN k < 2 THEN '' ELSE array_to_string(list_sort(list_transform(
         list_filter(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)) >= 2 AND x NOT IN ('healthy', 'balanced')),
         lambda x: concat(upper(substr(x, 1, 1)), substr(x, 2)))), ',') END AS recurring FROM w""", "telemetry"))
def w04_recurring_deficiency(spark, sf):
    h = TO.session_history(P.telemetry(spark, sf))
    return h.select("event_id", F.array_join(TO.recurring_deficiencies(F.col("history")), ",").alias("recurring"))


# --- F10 -------------------------------------------------------------------------------------------------
@register("f10_soil_health_rating", with_views("""
SELECT CASE WHEN ph BETWEEN 6.0 AND 7.5 THEN 30 WHEN (ph >= 5.0 AND ph < 6.0) OR (ph > 7.5 AND ph <= 8.5) THEN 20 ELSE 10 END
     + CASE WHEN N + P + K < 60 THEN 30 WHEN N + P + K > 350 THEN 40 ELSE 70 END AS rating, count(*) AS n
FROM telemetry GROUP BY 1""", "telemetry"))
def f10_soil_health_rating(spark, sf):
    return P.telemetry(spark, sf).groupBy(FX.soil_health_rating().alias("rating")).agg(F.count("*").alias("n"))


# --- J5 / J6 / R10 -------------------------------------------------------------------------------------------
def _graph_sql():
    parts = []
    for (name, _h, soils, _s, (dn, _p, _k), irrs, zones, sust, _f, fixer, _w) in K.GRAPH_NODES:
        def m(v, prefs):
            lst = "[" + ", ".join(S.q(p.lower()) for p in prefs) + "]"
            return f"len(list_filter({lst}, lambda p: contains({v}, p) OR contains(p, {v}))) > 0"
        off = " + ".join(f"CASE WHEN {v} <> '' AND {m(v, prefs)} THEN {a} WHEN {v} <> '' THEN {b} ELSE 0 END"
                         for v, prefs, a, b in (("soil", soils, 15, -10), ("zone", zones, 10, -5), ("irr", irrs, 10, -10)))
        if fixer:
            nr = "CASE WHEN nv < 50.0 THEN 20 ELSE 0 END"
        elif dn == "high":
            nr = "CASE WHEN nv < 50.0 THEN -15 WHEN nv > 120.0 THEN 10 ELSE 0 END"
        else:
            nr = "0"
        parts.append(f"WHEN {S.q(name)} THEN struct_pack(o := {off} + {nr}, b := {int(sust / 10)})")
    return "CASE lower(predicted_crop) " + " ".join(parts) + " ELSE struct_pack(o := 0, b := 0) END"


@register("r10_graph_compatibility", with_views(f"""
WITH g AS (SELECT predicted_crop, lower(coalesce(soil_texture, '')) AS soil, lower(coalesce(agro_climatic_zone, '')) AS zone,
                  lower(coalesce(irrigation_type, '')) AS irr, coalesce(N, 50.0) AS nv FROM field_requests),
r AS (SELECT predicted_crop, {_graph_sql()} AS x FROM g)
SELECT predicted_crop, x.o AS score_offset, x.b AS sustainability_bonus, count(*) AS n FROM r GROUP BY ALL""",
                                                "field_requests"))
def r10_graph_compatibility(spark, sf):
    fr = P.field_requests(spark, sf)
    g = TO.graph_compatibility(F.col("predicted_crop"), F.col("soil_texture"), F.col("agro_climatic_zone"),
                               F.col("irrigation_type"), F.col("N"))
    return (fr.select("predicted_crop", g["score_offset"].alias("score_offset"),
                      g["sustainability_bonus"].alias("sustainability_bonus"))
            .groupBy("predicted_crop", "score_offset", "sustainability_bonus").agg(F.count("*").alias("n")))


@register("j05_graph_lookup", with_views(f"""
SELECT predicted_crop, lower(predicted_crop) IN ({', '.join(S.q(n[0]) for n in K.GRAPH_NODES)}) AS has_node, count(*) AS n
FROM field_requests GROUP BY ALL""", "field_requests"))
def j05_graph_lookup(spark, sf):
    from ..sources import dims
    nodes = dims.graph_nodes(spark).select(F.col("crop").alias("_node"))
    fr = P.field_requests(spark, sf).join(F.broadcast(nodes), F.lower(F.col("predicted_crop")) == F.col("_node"), "left")
    return fr.groupBy("predicted_crop", F.col("_node").isNotNull().alias("has_node")).agg(F.count("*").alias("n"))


# --- R11: adaptive reasoning over telemetry (history before the entry, live weather, graph) -----------------
def adaptive_frame(spark, sf):
    from ..sources.proxies import location_of, _pick, SOIL_TEXTURES, AGRO_ZONES, IRRIGATION_TYPES
    tel = P.telemetry(spark, sf)
    loc = location_of(tel.withColumn("user_id", F.col("field_id")))
    hist = TO.session_history(loc, include_current=False)
    uid = F.col("field_id")
    hist = hist.withColumns({"soil_texture": _pick(SOIL_TEXTURES, uid % 6), "agro_climatic_zone": _pick(AGRO_ZONES, uid % 7),
                             "irrigation_type": _pick(IRRIGATION_TYPES, uid % 4), "req_id": F.col("event_id")})
    w = TO.weather_context(TO.asof_weather(hist, P.observations(spark, sf)))
    w = w.withColumns({"drift_prev": TO.drift(F.col("history")), "recurring": TO.recurring_deficiencies(F.col("history")),
                       "graph": TO.graph_compatibility(F.col("crop_prediction"), F.col("soil_texture"),
                                                       F.col("agro_climatic_zone"), F.col("irrigation_type"), F.col("N")),
                       "confidence_pct": F.lit(0.5) * 100.0 + (F.col("event_id") % 40).cast("double")})
    return TO.adaptive_score(w)


@register("r11_adaptive_reasoning")
def r11_adaptive_reasoning(spark, sf):
    """R11 per telemetry entry (rows-only check; the rules are unit-tested on the golden cases)."""
    a = adaptive_frame(spark, sf)
    return a.groupBy("soil_rebuild_urgency").agg(F.count("*").alias("n"), F.sum("intelligence_score").alias("sum_score"),
                                                 F.avg("kg_score").alias("avg_kg"))
