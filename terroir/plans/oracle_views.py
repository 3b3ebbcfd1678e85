"""SQL (DuckDB dialect) definitions of the derived views, for the oracle queries.

These are written independently of the DataFrame code in ``sources/proxies.py``;
``with_views(...)`` prefixes an oracle query with the CTEs it uses.
"""

from __future__ import annotations

from ..sources import knowledge as K

CROPS_LIST = "[" + ", ".join(f"'{c}'" for c in K.CROP_CLASSES) + "]"
CODES_LIST = "[" + ", ".join(str(c) for c, _ in K.WEATHER_CODES) + ", 42]"

VIEWS: dict[str, str] = {}

VIEWS["samples"] = f"""
samples_base AS (
  SELECT md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar),
                       cast(l_linenumber as varchar), cast(cast(l_shipdate as date) as varchar))) AS sample_id,
    l_quantity * cast(4 as double) AS N,
    cast((l_partkey % 41) * 5 as double) AS P,
    cast((l_suppkey * 7 + l_linenumber * 13) % 206 as double) AS K,
    cast(4 as double) + cast(l_partkey % 50 as double) / cast(10 as double) AS ph,
    l_discount * cast(20 as double) AS ec,
    l_tax * cast(50 as double) AS organic_carbon,
    cast((l_orderkey * 7 + l_linenumber * 13) % 101 as double) AS moisture,
    cast(10 + l_orderkey % 33 as double) AS temperature,
    cast(20 + l_partkey % 76 as double) AS humidity,
    l_extendedprice / cast(35 as double) AS rainfall,
    CASE WHEN month(l_shipdate) BETWEEN 6 AND 10 THEN 'kharif'
         WHEN month(l_shipdate) IN (4, 5) THEN 'summer' ELSE 'rabi' END AS season,
    r_name AS state, n_name AS region,
    cast((l_partkey * 3 + l_linenumber) % 22 as int) AS crop_code,
    cast((l_orderkey + l_linenumber) % 10 as int) AS noise
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
samples AS (SELECT *, {CROPS_LIST}[crop_code + 1] AS crop FROM samples_base)"""

VIEWS["samples_dirty"] = """
samples_nulled AS (
  SELECT * REPLACE (
    CASE WHEN noise = 0 AND crop_code % 3 = 0 THEN NULL ELSE N END AS N,
    CASE WHEN noise = 0 AND crop_code % 3 = 1 THEN NULL ELSE ph END AS ph,
    CASE WHEN noise = 0 AND crop_code % 3 = 2 THEN NULL ELSE rainfall END AS rainfall)
  FROM samples
),
samples_dirty AS (SELECT * FROM samples_nulled UNION ALL SELECT * FROM samples_nulled WHERE noise = 1)"""

VIEWS["predictions"] = f"""
predictions_base AS (
  SELECT sample_id, N, P, K, ph, moisture, noise, state, region, crop_code AS true_code,
         cast(CASE WHEN noise < 2 THEN (crop_code + 1) % 22 ELSE crop_code END as int) AS pred_code,
         crop AS true_label
  FROM samples
),
predictions AS (SELECT *, {CROPS_LIST}[pred_code + 1] AS predicted_label FROM predictions_base)"""

VIEWS["telemetry"] = f"""
telemetry AS (
  SELECT user_id AS field_id, event_id, epoch_us(ts) AS ts_us,
    cast((event_id * 11) % 150 as double) AS N,
    cast((event_id * 5) % 80 as double) AS P,
    cast((event_id * 3) % 90 as double) AS K,
    cast(4 as double) + cast(event_id % 50 as double) / cast(10 as double) AS ph,
    cast(10 as double) + value % cast(33 as double) AS temperature,
    cast(20 + (event_id * 7) % 76 as double) AS humidity,
    cast((event_id * 13) % 300 as double) AS rainfall,
    {CROPS_LIST}[(user_id + event_id) % 22 + 1] AS crop_prediction,
    CASE WHEN cast((event_id * 11) % 150 as double) < 40 THEN 'Nitrogen deficient'
         WHEN cast((event_id * 5) % 80 as double) < 20 THEN 'Phosphorus deficient'
         WHEN cast((event_id * 3) % 90 as double) < 30 THEN 'Potassium deficient'
         ELSE 'Balanced' END AS deficiency
  FROM events
)"""

VIEWS["observations"] = f"""
observations AS (
  SELECT event_id AS obs_id, epoch_us(ts) AS ts_us,
    cast(8 as double) + cast(user_id % 5 as double) * cast(0.5 as double) + cast(event_id % 4 as double) * cast(0.001 as double) AS lat,
    cast(76 as double) + cast(user_id % 3 as double) * cast(0.5 as double) + cast(event_id % 3 as double) * cast(0.001 as double) AS lon,
    cast(10 as double) + value % cast(33 as double) AS temperature,
    cast(15 + (event_id * 7) % 80 as double) AS humidity,
    value % cast(30 as double) AS rainfall,
    cast((event_id * 3) % 40 as double) AS wind_speed,
    cast((event_id * 17) % 200 as double) AS precip_7d,
    {CODES_LIST}[event_id % 25 + 1] AS weather_code
  FROM events WHERE event_type = 'view'
)"""

VIEWS["requests"] = f"""
requests AS (
  SELECT event_id AS req_id, user_id AS field_id, epoch_us(ts) AS ts_us,
    cast(8 as double) + cast(user_id % 5 as double) * cast(0.5 as double) + cast(event_id % 4 as double) * cast(0.001 as double) AS lat,
    cast(76 as double) + cast(user_id % 3 as double) * cast(0.5 as double) + cast(event_id % 3 as double) * cast(0.001 as double) AS lon,
    event_type = 'error' AS is_error,
    value AS latency_ms,
    cast(12 as double) + cast((event_id * 5) % 30 as double) AS temperature,
    cast(25 + (event_id * 3) % 70 as double) AS humidity,
    cast((event_id * 37) % 2000 as double) AS rainfall,
    ['rain-fed', 'canal irrigation', 'borewell', 'drip irrigation'][user_id % 4 + 1] AS irrigation_type,
    {CROPS_LIST}[(user_id * 3 + event_id) % 22 + 1] AS predicted_crop
  FROM events WHERE event_type IN ('purchase', 'error')
)"""

VIEWS["points"] = """
points AS (
  SELECT c_custkey AS point_id,
    cast((c_custkey * 7) % 600 as double) / cast(10 as double) - cast(2 as double) AS lon,
    cast((c_custkey * 11) % 560 as double) / cast(10 as double) - cast(1 as double) AS lat
  FROM customer
)"""

# polygons: one 8x8 square per nation at (10*(k%5), 10*floor(k/5)); ring vertices v0..v4 (closed)
VIEWS["polygons"] = """
polygons AS (
  SELECT n_nationkey AS feature_order, r_name AS state, n_name AS district,
         cast(n_nationkey % 5 as double) * cast(10 as double) AS x0,
         cast(floor(n_nationkey / 5) as double) * cast(10 as double) AS y0
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
polygon_vertices AS (
  SELECT feature_order, state, district, i,
         x0 + CASE WHEN i IN (1, 2) THEN cast(8 as double) ELSE cast(0 as double) END AS vx,
         y0 + CASE WHEN i IN (2, 3) THEN cast(8 as double) ELSE cast(0 as double) END AS vy
  FROM polygons CROSS JOIN range(0, 5) r(i)
),
polygon_edges AS (
  SELECT a.feature_order, a.state, a.district, a.vx AS x1, a.vy AS y1, b.vx AS x2, b.vy AS y2
  FROM polygon_vertices a JOIN polygon_vertices b ON a.feature_order = b.feature_order AND b.i = a.i + 1
)"""

# exact stratified 70/15/15 split: rank by md5(id#42) within the class
VIEWS["samples_split"] = """
samples_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY crop ORDER BY md5(concat_ws('#', sample_id, '42'))) - 1 AS split_rank,
         count(*) OVER (PARTITION BY crop) AS class_n
  FROM samples
),
samples_split AS (
  SELECT * EXCLUDE (split_rank, class_n),
         CASE WHEN split_rank < class_n * 70 // 100 THEN 'train'
              WHEN split_rank < class_n * 85 // 100 THEN 'val' ELSE 'test' END AS split
  FROM samples_ranked
)"""

def _pick_sql(options, idx):
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][{idx} + 1]"


_SCORE_TERMS = [f"(CASE WHEN {c} = pred_code THEN cast(0.5 as double) + cast(noise as double) * cast(0.04 as double) "
                f"ELSE cast(({c} * 7 + crop_code * 3 + noise) % 13 as double) / cast(40 as double) END)" for c in range(22)]

VIEWS["field_requests"] = f"""
fr_base AS (
  SELECT *, cast(CASE WHEN noise < 2 THEN (crop_code + 1) % 22 ELSE crop_code END as int) AS pred_code FROM samples
),
fr_scores AS (
  SELECT *, [{', '.join(_SCORE_TERMS)}] AS scores,
         {' + '.join(['cast(0 as double)'] + _SCORE_TERMS)} AS score_total FROM fr_base
),
field_requests AS (
  SELECT sample_id, N, P, K, ph, moisture, temperature, humidity, rainfall, state, region, crop, noise,
    season AS seasonal_context, {CROPS_LIST}[pred_code + 1] AS predicted_crop,
    cast(0.5 as double) + cast(noise as double) * cast(0.04 as double) AS confidence,
    list_transform(scores, lambda x: x / score_total) AS prob_list,
    {_pick_sql(['Low', 'Medium', 'High'], 'noise % 3')} AS fertility_pred,
    CASE WHEN N < 40 THEN 'Nitrogen deficient' WHEN P < 20 THEN 'Phosphorus deficient'
         WHEN K < 30 THEN 'Potassium deficient' ELSE 'Balanced' END AS deficiency_pred,
    {_pick_sql(['rain-fed', 'canal irrigation', 'borewell', 'drip irrigation'], '(crop_code + noise) % 4')} AS irrigation_type,
    {_pick_sql(['clay', 'loamy', 'sandy', 'black soil', 'red soil', 'clay loamy'], 'crop_code % 6')} AS soil_texture,
    {_pick_sql(['coastal', 'delta_region', 'arid', 'semi_arid', 'dry_plains', 'Delta Region', 'Semi-Arid Plains'], '(crop_code + noise) % 7')} AS agro_climatic_zone,
    {_pick_sql(['coastal', '', 'humid_coastal'], 'noise % 3')} AS region_zone,
    CASE WHEN noise % 4 = 0 THEN 'Thanjavur' WHEN noise % 4 = 1 THEN 'Coimbatore' ELSE region END AS district,
    CASE WHEN noise % 5 = 0 THEN concat('Taluk-', cast(crop_code as varchar)) END AS taluk
  FROM fr_scores
)"""

VIEW_DEPS = {
    "field_requests": ["samples"],
    "samples_dirty": ["samples"],
    "predictions": ["samples"],
    "samples_split": ["samples"],
}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the CTEs for ``views`` (dependencies first)."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in VIEW_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return sql.strip()
    ctes = ",\n".join(VIEWS[v].strip() for v in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
