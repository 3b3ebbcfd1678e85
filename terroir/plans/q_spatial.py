"""Spatial queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import checksum
from ..operators import rules as RU
from ..operators import spatial as SP
from ..session import shared_path
from ..sources import knowledge as K
from ..sources import proxies as P
from . import sqltext as S
from .catalog import register
from .oracle_views import with_views

R6 = lambda c: F.round(c, 6)

_INSIDE_SQL = """
cross_ AS (SELECT p.point_id, e.feature_order,
                  sum(CASE WHEN p.lat > least(y1, y2) AND p.lat <= greatest(y1, y2) AND p.lon <= greatest(x1, x2)
                            AND (x1 = x2 OR p.lon <= (p.lat - y1) * (x2 - x1) / (y2 - y1) + x1) THEN 1 ELSE 0 END) AS k
           FROM points p CROSS JOIN polygon_edges e GROUP BY ALL),
inside AS (SELECT point_id, min(feature_order) AS feature_order FROM cross_ WHERE k % 2 = 1 GROUP BY point_id)"""


@register("j02_point_in_polygon", with_views(f"""
WITH {_INSIDE_SQL}
SELECT i.point_id, i.feature_order, p.state, p.district FROM inside i JOIN polygons p USING (feature_order)""",
                                             "points", "polygons"))
def j02_point_in_polygon(spark, sf):
    return SP.point_in_polygon(P.points(spark, sf), P.polygons(spark, sf))


@register("s04_feature_collection", with_views(f"""
WITH {_INSIDE_SQL}
SELECT i.point_id, p.state FROM inside i JOIN polygons p USING (feature_order)""", "points", "polygons"))
def s04_feature_collection(spark, sf):
    """Districts written as feature collections, a MultiPolygon for each state, read again, and the points located in them."""
    states = P.polygons(spark, sf).select(F.dense_rank().over(Window.orderBy("state")).cast("long").alias("feature_order"), "state", "state", "ring").toDF(
        "feature_order", "state", "district", "ring")   # 25 districts
    path = shared_path(spark, f"features-{uuid.uuid4().hex}")
    SP.feature_collections(states, per_collection=2).select("value").write.text(path)
    return SP.point_in_polygon(P.points(spark, sf), SP.read_features(spark, path, multi_line=False)).select("point_id", "state")


@register("j03_nearest_fallback", with_views(f"""
WITH {_INSIDE_SQL},
d AS (SELECT p.point_id, g.feature_order, g.state, g.district, sqrt(pow(p.lon - g.x0, 2) + pow(p.lat - g.y0, 2)) AS dist
      FROM points p CROSS JOIN polygons g WHERE p.point_id NOT IN (SELECT point_id FROM inside)),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, feature_order) AS rn FROM d)
SELECT point_id, feature_order, state, district, round(dist, 6) AS dist FROM r WHERE rn = 1 AND dist < 2.0""",
                                             "points", "polygons"))
def j03_nearest_fallback(spark, sf):
    pts, polys = P.points(spark, sf), P.polygons(spark, sf)
    inside = SP.point_in_polygon(pts, polys)
    rest = pts.join(inside.select("point_id"), "point_id", "left_anti")
    return SP.nearest_first_vertex(rest, polys).withColumn("dist", R6(F.col("dist")))


# --- hierarchy ----------------------------------------------------------------------------------
_HIER_SQL = """
h AS (SELECT r_regionkey AS state_id, r_name AS state, n_nationkey AS district_id, n_name AS district,
             s_suppkey AS taluk_id, s_name AS taluk
      FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey),
hob AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"""


@register("j01_hierarchy_paths", with_views(f"""
WITH {_HIER_SQL}
SELECT state, district, count(DISTINCT taluk_id) AS n_taluks, count(l_partkey) AS n_hoblis
FROM h LEFT JOIN hob ON hob.l_suppkey = h.taluk_id GROUP BY state, district"""))
def j01_hierarchy_paths(spark, sf):
    paths = SP.hierarchy_paths(*P.hierarchy_levels(spark, sf))
    return paths.groupBy("state", "district").agg(F.count_distinct("taluk_id").alias("n_taluks"),
                                                  F.count("hobli_id").alias("n_hoblis"))


@register("j01_children_lookup", """
SELECT n.n_name AS name, n.n_nationkey AS id FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name = 'ASIA'""")
def j01_children_lookup(spark, sf):
    states, districts, _, _ = P.hierarchy_levels(spark, sf)
    return SP.children_of(states, districts, "state_id", "ASIA").select("name", "id")


@register("s05_ordered_states", """
SELECT r_name AS name, cast(row_number() OVER (ORDER BY r_name) as int) AS position FROM region""")
def s05_ordered_states(spark, sf):
    states = P.hierarchy_levels(spark, sf)[0]
    return SP.ordered_names(states)


@register("s06_boundary_etl", with_views("""
WITH d AS (SELECT DISTINCT state, district FROM polygons)
SELECT state, district, cast(dense_rank() OVER (ORDER BY state) as int) AS state_id,
       cast(dense_rank() OVER (ORDER BY state, district) as int) AS district_id,
       'Data Missing' AS taluk, 'Data Missing' AS hobli, 'Data Missing' AS village FROM d""", "polygons"))
def s06_boundary_etl(spark, sf):
    return SP.boundary_etl(P.polygons(spark, sf))


@register("s07_seed_load", """
WITH existing AS (SELECT s_suppkey AS id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
                  WHERE n_regionkey = 0),
incoming AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
loaded AS (SELECT * FROM existing UNION ALL SELECT * FROM incoming WHERE id NOT IN (SELECT id FROM existing))
SELECT count(*) AS total, count(DISTINCT id) AS distinct_ids, (SELECT count(*) FROM existing) AS existing FROM loaded""")
def s07_seed_load(spark, sf):
    _, districts, taluks, _ = P.hierarchy_levels(spark, sf)
    africa = districts.filter(F.col("state_id") == 0).select(F.col("id").alias("_d"))
    existing = taluks.join(F.broadcast(africa), F.col("district_id") == F.col("_d")).select("id", "name")
    incoming = taluks.select("id", "name")
    loaded = SP.seed_load(existing, incoming, "id")
    return loaded.agg(F.count("*").alias("total"), F.count_distinct("id").alias("distinct_ids")).withColumn(
        "existing", F.lit(existing.count()).cast("bigint"))


@register("a26_districts_per_state", with_views("""
SELECT state, array_to_string(list_sort(list(DISTINCT district)), ',') AS districts, count(DISTINCT district) AS n_districts
FROM polygons GROUP BY state""", "polygons"))
def a26_districts_per_state(spark, sf):
    return SP.districts_per_state(P.polygons(spark, sf))


# --- F14: grid key -------------------------------------------------------------------------------
def _round2_sql(x):
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 10)), 2) as decimal(38, 2))"


@register("f14_grid_key", with_views(f"""
SELECT concat(cast({_round2_sql('lat')} as varchar), '_', cast({_round2_sql('lon')} as varchar)) AS cell, count(*) AS n
FROM observations GROUP BY 1""", "observations"))
def f14_grid_key(spark, sf):
    from ..functions.features import grid_key
    return P.observations(spark, sf).groupBy(grid_key().alias("cell")).agg(F.count("*").alias("n"))


# --- R6 / R7 / J7 / J8: spatial reasoning on the top-3 crops -----------------------------------
def _tags_sql():
    return ("list_filter([lower(coalesce(region_zone, '')), replace(lower(coalesce(agro_climatic_zone, '')), ' ', '_'), "
            "lower(coalesce(irrigation_type, '')), lower(coalesce(soil_texture, '')), "
            "lower(coalesce(seasonal_context, ''))], lambda t: t <> '')")


@register("j08_tag_matches", with_views(f"""
WITH t AS (SELECT {_tags_sql()} AS tags FROM field_requests)
{' UNION ALL '.join(f"SELECT {S.q(crop)} AS crop, sum(len(list_filter(tags, lambda x: x IN ({', '.join(S.q(b) for b in bon)})))) AS bonus_hits, "
                    f"sum(len(list_filter(tags, lambda x: x IN ({', '.join(S.q(p) for p in pen)})))) AS penalty_hits FROM t"
                    for crop, (bon, pen, _, _) in K.CROP_TAG_MODIFIERS.items())}""", "field_requests"))
def j08_tag_matches(spark, sf):
    fr = P.field_requests(spark, sf)
    tags = SP.spatial_tags(F.col("region_zone"), F.col("agro_climatic_zone"), F.col("irrigation_type"),
                           F.col("soil_texture"), F.col("seasonal_context"))
    t = fr.select(tags.alias("tags"))
    parts = [t.agg(F.lit(crop).alias("crop"), F.sum(SP._count_in(F.col("tags"), bon)).cast("bigint").alias("bonus_hits"),
                   F.sum(SP._count_in(F.col("tags"), pen)).cast("bigint").alias("penalty_hits"))
             for crop, (bon, pen, _, _) in K.CROP_TAG_MODIFIERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("r07_region_intelligence", with_views(f"""
WITH z AS (SELECT *, replace(lower(coalesce(agro_climatic_zone, '')), ' ', '_') AS z, lower(coalesce(irrigation_type, '')) AS irr
           FROM field_requests),
i AS (SELECT CASE WHEN coalesce(taluk, '') <> '' THEN concat('Region Intelligence: ', coalesce(state, ''), ' > ', coalesce(district, ''), ' > ', taluk)
                  ELSE concat('Region Intelligence: ', coalesce(state, ''), ' (', coalesce(district, ''), ')') END AS title,
        list_sort(list_distinct(list_filter([
          CASE WHEN z IN ('coastal', 'delta_region') THEN {S.q(K.SPATIAL_TEXT['wet_context'])} WHEN z IN ('arid', 'semi_arid', 'dry_plains') THEN {S.q(K.SPATIAL_TEXT['dry_context'])} END,
          CASE WHEN district = 'Thanjavur' THEN 'Rainfall zone: High rainfall.' END,
          CASE WHEN district = 'Coimbatore' THEN 'Rainfall zone: Low rainfall.' END], lambda x: x IS NOT NULL))) AS ctx,
        list_sort(list_distinct(list_filter([
          CASE WHEN z IN ('coastal', 'delta_region') THEN {S.q(K.SPATIAL_TEXT['wet_risk'])} WHEN z IN ('arid', 'semi_arid', 'dry_plains') THEN {S.q(K.SPATIAL_TEXT['dry_risk'])} END,
          CASE WHEN district = 'Coimbatore' THEN {S.q(K.SPATIAL_TEXT['district_drought'])} END,
          CASE WHEN district = 'Thanjavur' THEN {S.q(K.SPATIAL_TEXT['district_flood'])} END,
          CASE WHEN district = 'Thanjavur' THEN {S.q(K.SPATIAL_TEXT['district_salinity'])} END], lambda x: x IS NOT NULL))) AS risks,
        coalesce(CASE irr {' '.join(f'WHEN {S.q(k)} THEN {S.q(d)}' for k, (_, d) in K.IRRIGATION_DEPENDENCE.items())} END, '') AS assess
      FROM z)
SELECT {S.joined('ctx')} AS context, {S.joined('risks')} AS risks, assess AS irrigation_assessment, count(*) AS n,
       sum({S.ck('title')}) AS title_ck FROM i GROUP BY ALL""", "field_requests"))
def r07_region_intelligence(spark, sf):
    fr = P.field_requests(spark, sf)
    intel = SP.region_intelligence(F.col("state"), F.col("district"), F.col("taluk"), F.col("agro_climatic_zone"),
                                   F.col("irrigation_type"))
    t = fr.select(intel.alias("i"))
    return (t.select(F.array_join("i.environmental_context", " | ").alias("context"),
                     F.array_join("i.environmental_risks", " | ").alias("risks"),
                     F.col("i.irrigation_assessment").alias("irrigation_assessment"), checksum(F.col("i.title")).alias("tck"))
            .groupBy("context", "risks", "irrigation_assessment")
            .agg(F.count("*").alias("n"), F.sum("tck").alias("title_ck")))


def r06_spatial_adjustment_df(spark, sf):
    from .q_rules import _requests
    d = RU.with_ranked(_requests(spark, sf))
    tags = SP.spatial_tags(F.col("region_zone"), F.col("agro_climatic_zone"), F.col("irrigation_type"),
                           F.col("soil_texture"), F.col("seasonal_context"))
    d = d.withColumn("_tags", tags).select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("_i"))
    d = d.withColumn("_x", F.col("_top")[F.col("_i")]).withColumn("_p", RU.profile_at(F.col("_x.o")))
    t = RU.texts(F.col("_p"))
    c = {"crop": F.col("_x.crop"), "suitability_score": F.col("_x.score"), "advantages": t["advantages"], "risks": t["risks"]}
    return d.select("sample_id", "district", SP.adjust_crop(c, F.col("_tags"), F.col("district")).alias("c")).select("sample_id", "district", "c.*")


@register("r06_spatial_adjustment")
def r06_spatial_adjustment(spark, sf):
    """R6 on the top-3 crops of every request (rows-only check; rule cases are unit-tested)."""
    e = r06_spatial_adjustment_df(spark, sf)
    return e.groupBy("crop").agg(F.count("*").alias("n"), F.sum("suitability_score").alias("sum_score"),
                                 F.sum(checksum(F.array_join("advantages", " | "))).alias("adv_ck"),
                                 F.sum(checksum(F.array_join("risks", " | "))).alias("risk_ck"))
