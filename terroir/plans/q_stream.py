"""Streaming queries (Z1-Z6): each replays the events table as a file stream in several micro-batches, runs the
stream to completion (``availableNow``) and returns the sink table.  The oracles are those of the batch twins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import knowledge as K
from ..streaming import streams as Z
from .catalog import register
from .oracle_views import with_views
from .q_time import _ASOF_SQL, _W, TTL, R6, _cell_sql

PARTS = 3   # files of successive times, one a trigger


def _events(spark, sf, name):
    return Z.event_stream(spark, Z.replay_events(spark, sf, name, PARTS), 1)


@register("z01_session_memory_stream", with_views(f"""
WITH w AS (SELECT event_id, count(*) {_W} AS k, first_value(event_id) {_W} AS first_event, first_value(temperature) {_W} AS t0, temperature AS t1,
                  first_value(humidity) {_W} AS h0, humidity AS h1, first_value(rainfall) {_W} AS r0, rainfall AS r1,
                  list(lower(split_part(deficiency, ' ', 1))) {_W} AS l FROM telemetry)
SELECT event_id, k AS hist_len, first_event, round(CASE WHEN k >= 2 THEN t1 - t0 ELSE 0.0 END, 6) AS temp_drift,
       CASE WHEN k >= 2 THEN (t1 - t0 > 2.0 AND h1 < h0) ELSE false END AS drought_trend,
       CASE WHEN k < 2 THEN 'stable' WHEN r1 < r0 - 50.0 THEN 'drying' WHEN r1 > r0 + 50.0 THEN 'wetting' ELSE 'stable' END AS rainfall_trend,
       CASE WHEN k < 2 THEN '' ELSE array_to_string(list_sort(list_transform(
         list_filter(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)) >= 2 AND x NOT IN ('healthy', 'balanced')),
         lambda x: concat(upper(substr(x, 1, 1)), substr(x, 2)))), ',') END AS recurring FROM w""", "telemetry"))
def z01_session_memory_stream(spark, sf):
    out = Z.run_to_completion(Z.session_memory_stream(_events(spark, sf, "z01")), "z01", spark)
    return out.select("event_id", F.col("hist_len").cast("bigint").alias("hist_len"), "first_event", R6(F.col("temp_drift")).alias("temp_drift"),
                      "drought_trend", "rainfall_trend", "recurring")


@register("z02_cell_dedup_stream", with_views(f"""
SELECT cell, unnest(list_reduce([[]] || list([struct_pack(ts_us, obs_id)] ORDER BY ts_us, obs_id),
         lambda kept, o: CASE WHEN len(kept) = 0 OR o[1].ts_us - kept[-1].ts_us > {TTL} THEN kept || o ELSE kept END)).obs_id AS obs_id
FROM (SELECT {_cell_sql()} AS cell, ts_us, obs_id FROM observations) GROUP BY cell""", "observations"))
def z02_cell_dedup_stream(spark, sf):
    out = Z.run_to_completion(Z.cell_dedup_stream(_events(spark, sf, "z02")), "z02", spark)
    return out.select("cell", F.col("event_id").alias("obs_id"))


@register("z03_weather_join_stream", with_views(f"""
WITH {_ASOF_SQL}
SELECT req_id, cell, obs_id FROM aw""", "requests", "observations"))
def z03_weather_join_stream(spark, sf):
    return Z.run_to_completion(Z.weather_join_stream(_events(spark, sf, "z03")), "z03", spark).select("req_id", "cell", "obs_id")


def _metrics_sql(starts: str) -> str:
    return f"""
WITH {_ASOF_SQL},
w AS (SELECT *, unnest({starts}) AS s FROM aw),
c AS (SELECT s, predicted_crop, count(*) AS n FROM w WHERE NOT is_error GROUP BY ALL),
p AS (SELECT s, string_agg(concat(predicted_crop, '=', n), ',' ORDER BY predicted_crop) AS predictions FROM c GROUP BY s)
SELECT w.s AS window_start_s, count(*) AS requests, count_if(is_error) AS errors, round(count_if(is_error) / count(*) * 100.0, 2) AS error_rate_percent,
       round(avg(latency_ms), 6) AS mean_latency, round(count(obs_id) / count(*), 2) AS cache_hit_ratio, coalesce(any_value(predictions), '') AS predictions
FROM w LEFT JOIN p ON w.s = p.s GROUP BY w.s"""


def _metrics(spark, sf, name, sliding):
    out = Z.run_to_completion(Z.metrics_stream(_events(spark, sf, name), sliding), name, spark)
    listed = F.array_join(F.transform(F.array_sort("predictions"), lambda p: F.concat(p["crop"], F.lit("="), p["n"].cast("string"))), ",")
    return out.select(F.unix_seconds("window_start").alias("window_start_s"), "requests", "errors", "error_rate_percent", R6(F.col("mean_latency")).alias("mean_latency"),
                      "cache_hit_ratio", listed.alias("predictions"))


@register("z04_metrics_stream", with_views(_metrics_sql("[ts_us // 300000000 * 300]"), "requests", "observations"))
def z04_metrics_stream(spark, sf):
    return _metrics(spark, sf, "z04", False)


@register("z04_metrics_stream_sliding", with_views(_metrics_sql("[ts_us // 300000000 * 300, ts_us // 300000000 * 300 - 300]"), "requests", "observations"))
def z04_metrics_stream_sliding(spark, sf):
    return _metrics(spark, sf, "z04s", True)


@register("z05_sessions_stream", with_views("""
WITH g AS (SELECT field_id, ts_us, CASE WHEN ts_us < lag(ts_us) OVER o + 1800000000 THEN 0 ELSE 1 END AS new FROM telemetry
           WINDOW o AS (PARTITION BY field_id ORDER BY ts_us)),
s AS (SELECT *, sum(new) OVER (PARTITION BY field_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT field_id, min(ts_us) AS start_us, max(ts_us) + 1800000000 AS end_us, count(*) AS readings FROM s GROUP BY field_id, k""", "telemetry"))
def z05_sessions_stream(spark, sf):
    out = Z.run_to_completion(Z.sessions_stream(_events(spark, sf, "z05")), "z05", spark)
    return out.select("field_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "readings")


_BOUNDS = {c: K.ROW_BOUNDS[c] for c in ("temperature", "humidity", "N") if c in K.ROW_BOUNDS}
_VALID = " AND ".join(f"coalesce({c} {op} {v}, true)" for c, (lo, hi) in _BOUNDS.items() for op, v in ((">=", lo), ("<=", hi)) if v is not None)


@register("z06_quarantine_stream", f"""
WITH v AS (SELECT value / 5.0::DOUBLE - 20.0::DOUBLE AS temperature, (event_id * 7 % 120)::DOUBLE AS humidity, (event_id * 11 % 220)::DOUBLE AS N FROM events)
SELECT CASE WHEN {_VALID} THEN 'good' ELSE 'quarantine' END AS "table", count(*) AS rows FROM v GROUP BY 1""")
def z06_quarantine_stream(spark, sf):
    base = shared_path(spark, f"terroir-stream/z06-{uuid.uuid4().hex}")
    Z.run_into_sink(Z.validation_input(_events(spark, sf, "z06")), spark, base)
    counts = [Z.EpochSink.read(spark, base, t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows")) for t in Z.EpochSink.TABLES]
    return counts[0].unionByName(counts[1]).filter("rows > 0")
