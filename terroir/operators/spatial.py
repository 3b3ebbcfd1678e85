"""Spatial operators: feature collections, hierarchy joins, point-in-polygon, nearest fallback, spatial rules.

Point-in-polygon is an equi-join on a hierarchical cell cover, not a nested-loop join.  A polygon starts with the
few cells of its own size that its bounding box meets; a cell keeps the edges that can still change the crossing
number of a point in it, and the parity of those that always cross.  Cells with more edges than a budget are
split in four.  A cell that no edge comes into is inside (no ray cast) or dropped, and a point is tested exactly with the
few edges of its cell, by the rule of ``ray_cast_inside``.  Points look up their cell at each level in use.  The
nearest-vertex fallback uses cells as wide as the distance limit, looking at the 3 x 3 neighbourhood, so it is
exact without comparing every point with every polygon.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import knowledge as K
from .scan import ranked

NEAREST_LIMIT = 2.0


def ray_cast_inside(x: Column, y: Column, ring: Column) -> Column:
    """crossing-number test over the ring's edges (including the closing edge).

    An edge (a, b) toggles when min(ay, by) < y <= max(ay, by), x <= max(ax, bx) and
    (ax == bx or x <= the edge's x at height y).  Points on the upper/right boundary
    follow this rule exactly.
    """
    n = F.size(ring)

    def toggle(acc, i):
        a = ring[i]
        b = ring[(i + 1) % n]
        ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
        xint = (y - ay) * (bx - ax) / (by - ay) + ax
        cross = ((y > F.least(ay, by)) & (y <= F.greatest(ay, by)) & (x <= F.greatest(ax, bx))
                 & ((ax == bx) | (x <= xint)))
        return acc != F.coalesce(cross, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), toggle)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """planar distance in degrees."""
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


#: Side of a cell of level 0 in degrees; a cell of the next level is half as wide.  Powers of two, so that corners and cell numbers are exact.
CELL, MAX_LEVEL = 512.0, 30
EDGE_BUDGET = 64
#: Degrees by which an edge must miss a cell to count as missing it; far more than rounding, far less than a cell.
MARGIN = 1e-9


def _relevant(edge: Column, x0: Column, y0: Column, side: Column) -> Column:
    """Whether an edge can change the crossing number of a point of the cell: it reaches into its band of heights and not only left of it."""
    return ((F.greatest(edge["ay"], edge["by"]) >= y0) & (F.least(edge["ay"], edge["by"]) < y0 + side) & (F.greatest(edge["ax"], edge["bx"]) >= x0))


def _always(edge: Column, x0: Column, y0: Column, side: Column) -> Column:
    """Whether every point of the cell counts the edge: it lies right of the cell and spans its heights."""
    return ((F.least(edge["ax"], edge["bx"]) > x0 + side * 1.0000001) & (F.least(edge["ay"], edge["by"]) < y0)
            & (F.greatest(edge["ay"], edge["by"]) >= y0 + side))


def _touches(edge: Column, x0: Column, y0: Column, side: Column) -> Column:
    """Whether an edge may come into the cell: their boxes meet and the cell's corners are not all on one side of it."""
    left, right, low, high = x0 - MARGIN, x0 + side + MARGIN, y0 - MARGIN, y0 + side + MARGIN
    ax, ay, bx, by = edge["ax"], edge["ay"], edge["bx"], edge["by"]
    boxes = (F.greatest(ax, bx) >= left) & (F.least(ax, bx) <= right) & (F.greatest(ay, by) >= low) & (F.least(ay, by) <= high)
    sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (left, right) for y in (low, high)]
    return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _cut_to_cell(cells: DataFrame) -> DataFrame:
    """``edges`` and ``parity`` of cells (level, cx, cy) from those of a larger cell; cells that are outside go."""
    side = F.lit(CELL) / F.pow(F.lit(2.0), F.col("level"))
    c = cells.withColumns({"_side": side, "_x0": F.col("cx") * side, "_y0": F.col("cy") * side})
    box = (F.col("_x0"), F.col("_y0"), F.col("_side"))
    crossed = F.size(F.filter("edges", lambda e: _always(e, *box)))
    c = c.withColumn("parity", (F.col("parity") + crossed) % 2)
    c = c.withColumn("edges", F.filter("edges", lambda e: _relevant(e, *box) & ~_always(e, *box)))
    # a cell that no edge comes into is all inside or all outside, as its centre is
    empty = ~F.exists("edges", lambda e: _touches(e, *box))
    centre = _crossed(F.col("_x0") + F.col("_side") / 2, F.col("_y0") + F.col("_side") / 2, F.col("edges"), F.col("parity"))
    c = c.withColumn("parity", F.when(empty, centre.cast("int")).otherwise(F.col("parity")))
    c = c.withColumn("edges", F.when(empty, F.slice("edges", 1, 0)).otherwise(F.col("edges")))
    return c.filter((F.size("edges") > 0) | (F.col("parity") == 1)).drop("_side", "_x0", "_y0")


def polygon_cover(polygons: DataFrame, budget: int = EDGE_BUDGET) -> DataFrame:
    """The cell cover of ``polygons (feature_order, state, district, ring)``; a feature may have several rows (parts).

    Rows ``(feature_order, state, district, level, cx, cy, parity, edges)``, stored in the shared folder.  Rings of
    fewer than three points contain nothing."""
    spark = polygons.sparkSession
    n = F.size("ring")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.col("ring")[i]["x"].alias("ax"), F.col("ring")[i]["y"].alias("ay"), F.col("ring")[(i + 1) % n]["x"].alias("bx"), F.col("ring")[(i + 1) % n]["y"].alias("by")))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    b = polygons.filter(n >= 3).select("feature_order", "state", "district", edges.alias("edges"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
                                       F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(CELL / 2.0 ** MAX_LEVEL))
    b = b.withColumn("level", F.least(F.greatest(F.floor(F.log2(F.lit(CELL) / wide)) + 1, F.lit(0)), F.lit(MAX_LEVEL)).cast("int"))
    at = lambda v: F.floor(F.col(v) * F.pow(F.lit(2.0), F.col("level")) / CELL)
    b = b.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    names = ["feature_order", "state", "district", "level", "cx", "cy", "parity", "edges"]
    todo = _cut_to_cell(b.withColumn("parity", F.lit(0))).select(*names)
    base, step, paths = shared_path(spark, f"cover-{uuid.uuid4().hex}"), 0, []
    while True:
        todo.write.parquet(f"{base}/{step}")
        cells = spark.read.schema(todo.schema).parquet(f"{base}/{step}")
        paths.append(cells.filter((F.size("edges") <= budget) | (F.col("level") >= MAX_LEVEL)))
        full = cells.filter((F.size("edges") > budget) & (F.col("level") < MAX_LEVEL))
        if full.isEmpty():
            break
        quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        children = full.withColumn("_q", quarters).withColumns({"level": F.col("level") + 1, "cx": F.col("cx") * 2 + F.col("_q.i"), "cy": F.col("cy") * 2 + F.col("_q.j")})
        todo, step = _cut_to_cell(children.drop("_q")).select(*names), step + 1
    cover = paths[0]
    for more in paths[1:]:
        cover = cover.unionByName(more)
    cover.write.parquet(f"{base}/cover")
    return spark.read.schema(cover.schema).parquet(f"{base}/cover")


def _crossed(x: Column, y: Column, edges: Column, parity: Column) -> Column:
    """Odd crossing number, by the rule of ``ray_cast_inside``, from the edges of a cell and its parity."""
    def toggle(acc, e):
        ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
        xint = (y - ay) * (bx - ax) / F.when(by != ay, by - ay) + ax
        cross = ((y > F.least(ay, by)) & (y <= F.greatest(ay, by)) & (x <= F.greatest(ax, bx)) & ((ax == bx) | (x <= xint)))
        return acc != F.coalesce(cross, F.lit(False))

    return F.aggregate(edges, parity == 1, toggle)


def point_in_polygon(points: DataFrame, polygons: DataFrame, budget: int = EDGE_BUDGET,
                     x: str = "lon", y: str = "lat", id_col: str = "point_id") -> DataFrame:
    """For each point, the first polygon (lowest ``feature_order``) that contains it.  Points without a
    position are in none."""
    cover = polygon_cover(polygons, budget)
    levels = [r["level"] for r in cover.select("level").distinct().collect()]   # at most MAX_LEVEL + 1
    if not levels:
        return cover.select(F.lit(None).cast(points.schema[id_col].dataType).alias(id_col), "feature_order", "state", "district")
    # the cover is read from files: the planner broadcasts it by their size or shuffles both sides and splits hot cells
    pts = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        id_col, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    at = lambda v: F.floor(F.col(v) * F.pow(F.lit(2.0), F.col("level")) / CELL)
    met = pts.withColumns({"cx": at("_x"), "cy": at("_y")}).join(cover, ["level", "cx", "cy"])
    inside = met.filter(_crossed(F.col("_x"), F.col("_y"), F.col("edges"), F.col("parity")))
    best = inside.groupBy(id_col).agg(F.min(F.struct("feature_order", "state", "district")).alias("f"))
    return best.select(id_col, "f.feature_order", "f.state", "f.district")


# --- S4: feature collections ----------------------------------------------------------------------
_FEATURES = ("type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>")
_RING = "array<array<double>>"


def read_features(spark: SparkSession, path: str, multi_line: bool = True, state: str = "state", district: str = "district") -> DataFrame:
    """The polygons of feature-collection JSON files (one collection a file, or one a line without ``multi_line``).

    A row for each part of a Polygon or MultiPolygon feature: ``feature_order`` (file, then place in it), ``state`` and
    ``district`` from the properties named so, ``part`` and ``ring`` (the outer one).  Other geometries and
    features without coordinates have no row but keep their place."""
    found = spark.read.schema(_FEATURES).option("multiLine", multi_line).json(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "features")
    each = found.select("file", "block", "line", F.posexplode("features").alias("place", "f"))
    placed = ranked(each.select("file", "block", "line", "place", F.to_json("f").alias("f")), [], [F.col("file"), F.col("block"), F.col("line"), F.col("place")], "feature_order", "features")
    f = F.from_json("f", "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>")
    g = placed.select((F.col("feature_order") - 1).alias("feature_order"), f["properties"].alias("p"), f["geometry"]["type"].alias("kind"), f["geometry"]["coordinates"].alias("c"))
    rings = (F.when(F.col("kind") == "Polygon", F.array(F.get(F.from_json("c", f"array<{_RING}>"), F.lit(0))))
             .when(F.col("kind") == "MultiPolygon", F.transform(F.from_json("c", f"array<array<{_RING}>>"), lambda part: F.get(part, F.lit(0)))))
    parts = g.select("feature_order", F.col("p")[state].alias("state"), F.col("p")[district].alias("district"), F.posexplode(rings).alias("part", "ring"))
    point = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    return parts.filter(F.size("ring") > 0).withColumn("ring", F.transform("ring", point))


def feature_collections(polygons: DataFrame, per_collection: int = 1000) -> DataFrame:
    """``value``: collections as JSON texts of bounded numbers of features; rows of one ``feature_order`` are a MultiPolygon."""
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    parts = polygons.groupBy("feature_order", "state", "district").agg(F.collect_list(F.array(ring)).alias("parts"))   # the parts of a feature
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("state", "district").alias("properties"), geometry.alias("geometry"))
    chunk = F.floor(F.col("feature_order") / per_collection)
    listed = parts.groupBy(chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("feature_order", feature.alias("f")))).alias("fs"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda f: f["f"]).alias("features"))
    return listed.select("chunk", F.to_json(whole).alias("value"))


def nearest_first_vertex(points: DataFrame, polygons: DataFrame, limit: float = NEAREST_LIMIT,
                         x: str = "lon", y: str = "lat", id_col: str = "point_id") -> DataFrame:
    """Nearest polygon by distance to its ring's first vertex, if closer than ``limit``.

    Vertices are bucketed in cells of side ``limit``; a point only meets the vertices
    in its own and the 8 neighbouring cells, which contain every vertex within ``limit``.
    Ties go to the earlier feature (file order).
    """
    v = polygons.select("feature_order", "state", "district", F.col("ring")[0]["x"].alias("vx"),
                        F.col("ring")[0]["y"].alias("vy"))
    v = v.withColumns({"cx": F.floor(F.col("vx") / limit), "cy": F.floor(F.col("vy") / limit)})
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    pts = points.select(id_col, x, y, F.explode(offsets).alias("o")).withColumns({
        "cx": F.floor(F.col(x) / limit) + F.col("o.dx"), "cy": F.floor(F.col(y) / limit) + F.col("o.dy")})
    cand = pts.join(v, ["cx", "cy"]).withColumn("dist", distance(F.col(x), F.col(y), F.col("vx"), F.col("vy")))
    cand = cand.filter(F.col("dist") < limit)
    best = cand.groupBy(id_col).agg(F.min_by(F.struct("feature_order", "state", "district", "dist"),
                                               F.struct("dist", "feature_order")).alias("f"))
    return best.select(id_col, "f.feature_order", "f.state", "f.district", "f.dist")


def resolve_location(points: DataFrame, polygons: DataFrame, **kw) -> DataFrame:
    """J2 then J3 for the points no polygon contains (``left_anti``); unresolved points are dropped."""
    id_col = kw.get("id_col", "point_id")
    inside = point_in_polygon(points, polygons, **kw).withColumn("method", F.lit("inside"))
    rest = points.join(inside.select(id_col), id_col, "left_anti")
    near = nearest_first_vertex(rest, polygons, **{k: v for k, v in kw.items() if k != "budget"})
    return inside.unionByName(near.drop("dist").withColumn("method", F.lit("nearest")))


# --- hierarchy (J1, S5-S7, A26) -------------------------------------------------------------

def hierarchy_paths(states: DataFrame, districts: DataFrame, taluks: DataFrame, hoblis: DataFrame) -> DataFrame:
    """The full state -> district -> taluk -> hobli path, joined on ids (not names)."""
    sd = districts.alias("d").join(F.broadcast(states.alias("s")), F.col("d.state_id") == F.col("s.id")).select(
        F.col("s.id").alias("state_id"), F.col("s.name").alias("state"), F.col("d.id").alias("district_id"),
        F.col("d.name").alias("district"))
    # states/districts are the two fixed-size levels; taluks and hoblis grow with the data
    t = taluks.select(F.col("id").alias("taluk_id"), F.col("district_id").alias("_tdist"), F.col("name").alias("taluk"))
    st = t.join(F.broadcast(sd), F.col("_tdist") == F.col("district_id")).drop("_tdist")
    h = hoblis.select(F.col("id").alias("hobli_id"), F.col("taluk_id").alias("_htal"), F.col("name").alias("hobli"))
    return st.join(h, F.col("_htal") == F.col("taluk_id"), "left").drop("_htal")


def children_of(parent: DataFrame, child: DataFrame, fk: str, parent_name: str) -> DataFrame:
    """J1 lookup: children of the parent(s) with this name, ordered by child name."""
    p = parent.filter(F.col("name") == parent_name).select(F.col("id").alias("_pid"))
    return child.join(F.broadcast(p), F.col(fk) == F.col("_pid")).drop("_pid").orderBy("name")


def ordered_names(level: DataFrame) -> DataFrame:
    """A level's names in name order, with their position."""
    from pyspark.sql import Window
    return level.select("name").withColumn("position", F.row_number().over(Window.orderBy("name")).cast("int"))


def boundary_etl(features: DataFrame, state_col: str = "state", district_col: str = "district") -> DataFrame:
    """Map boundary properties to levels, fill the lower levels, assign surrogate ids.

    Ids are ``dense_rank`` over the distinct names (the ranking runs on the distinct
    state / district sets only).
    """
    from pyspark.sql import Window
    d = features.select(F.col(state_col).alias("state"), F.col(district_col).alias("district")).distinct()
    d = d.withColumn("state_id", F.dense_rank().over(Window.orderBy("state")).cast("int"))
    d = d.withColumn("district_id", F.dense_rank().over(Window.orderBy("state", "district")).cast("int"))
    return d.withColumns({"taluk": F.lit("Data Missing"), "hobli": F.lit("Data Missing"), "village": F.lit("Data Missing")})


def seed_load(existing: DataFrame, new: DataFrame, key) -> DataFrame:
    """Idempotent load - rows whose key already exists are ignored (``INSERT OR IGNORE``)."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def districts_per_state(paths: DataFrame) -> DataFrame:
    """Distinct districts per state, as a sorted list and a count."""
    return paths.groupBy("state").agg(F.array_join(F.array_sort(F.collect_set("district")), ",").alias("districts"),
                                      F.count_distinct("district").alias("n_districts"))


# --- spatial reasoning (J7, J8, R6, R7) ---------------------------------------------------------

def spatial_tags(region_zone: Column, agro_zone: Column, irrigation: Column, soil: Column, season: Column) -> Column:
    """The request's tags: zone, agro-climatic zone (spaces -> '_'), irrigation, soil, season; empty dropped."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tags = F.array(low(region_zone), F.regexp_replace(low(agro_zone), " ", "_"), low(irrigation), low(soil), low(season))
    return F.filter(tags, lambda t: t != "")


def _count_in(tags: Column, values) -> Column:
    """How many tags are in ``values`` - a tag present twice counts twice."""
    return F.size(F.filter(tags, lambda t: t.isin(*values)))


def adjust_crop(c: Column | dict[str, Column], tags: Column, district: Column) -> Column:
    """R6 of one crop (``crop, suitability_score, advantages, risks``): +-5 per matched tag (clamp 10-99), district zone +-10, appended texts.

    The crop's tags and the zone's crops are looked up, so an expression occurs once however many crops have tags."""
    strings = lambda values: F.array(*[F.lit(v) for v in values])
    none = F.array().cast("array<string>")
    mods = F.create_map(*[x for crop, (bon, pen, btxt, ptxt) in K.CROP_TAG_MODIFIERS.items() for x in (
        F.lit(crop), F.struct(strings(bon).alias("bon"), strings(pen).alias("pen"), strings([btxt]).alias("btxt"), strings([ptxt]).alias("ptxt")))])
    zones = F.create_map(*[x for d, v in K.DISTRICT_PROFILES.items() if v[0] in K.ZONE_MODIFIERS for x in (F.lit(d), F.struct(
        *[strings(crops).alias(n) for n, crops in zip(("bon", "pen"), K.ZONE_MODIFIERS[v[0]])],
        *[strings([K.SPATIAL_TEXT[t].replace("{zone}", v[0])]).alias(n) for n, t in (("btxt", "zone_bonus"), ("ptxt", "zone_penalty"))]))])
    name = F.lower(c["crop"])
    mod, zone = mods[name], zones[district]

    def hits(values: Column) -> Column:      # a tag present twice counts twice
        return F.coalesce(F.size(F.filter(tags, lambda t: F.array_contains(values, t))), F.lit(0))

    nb, np_ = F.when(mod.isNotNull(), hits(mod["bon"])).otherwise(0), F.when(mod.isNotNull(), hits(mod["pen"])).otherwise(0)
    zb, zp = (F.coalesce(F.array_contains(zone[n], name), F.lit(False)) for n in ("bon", "pen"))
    score = F.when(mod.isNotNull(), F.greatest(F.lit(10), F.least(F.lit(99), c["suitability_score"] + nb * 5 - np_ * 5))).otherwise(c["suitability_score"])
    score = F.when(zb, F.least(F.lit(99), score + 10)).otherwise(score)
    score = F.when(zp, F.greatest(F.lit(10), score - 10)).otherwise(score)
    adv = F.concat(c["advantages"], F.when(nb > 0, mod["btxt"]).otherwise(none), F.when(zb, zone["btxt"]).otherwise(none))
    risk = F.concat(c["risks"], F.when(np_ > 0, mod["ptxt"]).otherwise(none), F.when(zp, zone["ptxt"]).otherwise(none))
    return F.struct(c["crop"].alias("crop"), score.alias("suitability_score"), adv.alias("advantages"), risk.alias("risks"))


def adjust_top_crops(top: Column, tags: Column, district: Column) -> Column:
    """R6 of each top crop."""
    return F.transform(top, lambda c: adjust_crop(c, tags, district))


def region_intelligence(state: Column, district: Column, taluk: Column, agro_zone: Column, irrigation: Column) -> Column:
    """Title, context, risks (sorted, de-duplicated) and irrigation assessment."""
    ST = K.SPATIAL_TEXT
    z = F.regexp_replace(F.lower(F.coalesce(agro_zone, F.lit(""))), " ", "_")
    irr = F.lower(F.coalesce(irrigation, F.lit("")))
    s, d = F.coalesce(state, F.lit("")), F.coalesce(district, F.lit(""))
    title = F.when(F.coalesce(taluk, F.lit("")) != "", F.concat(F.lit("Region Intelligence: "), s, F.lit(" > "), d,
                                                               F.lit(" > "), taluk)).otherwise(
        F.concat(F.lit("Region Intelligence: "), s, F.lit(" ("), d, F.lit(")")))
    assess = F.coalesce(F.create_map(*[x for k, (_, desc) in K.IRRIGATION_DEPENDENCE.items() for x in (F.lit(k), F.lit(desc))])[irr],
                        F.lit(""))
    risks = [F.when(z.isin(*K.WET_ZONES), F.lit(ST["wet_risk"])).when(z.isin(*K.DRY_ZONES), F.lit(ST["dry_risk"]))]
    context = [F.when(z.isin(*K.WET_ZONES), F.lit(ST["wet_context"])).when(z.isin(*K.DRY_ZONES), F.lit(ST["dry_context"]))]
    for name, (zone, rain_zone, drought, _hum, _irr, salinity, flood, _t) in K.DISTRICT_PROFILES.items():
        hit = d == name
        if drought == "high":
            risks.append(F.when(hit, F.lit(ST["district_drought"])))
        if flood == "high":
            risks.append(F.when(hit, F.lit(ST["district_flood"])))
        if salinity == "high":
            risks.append(F.when(hit, F.lit(ST["district_salinity"])))
        context.append(F.when(hit, F.lit(f"Rainfall zone: {rain_zone.replace('_', ' ').capitalize()}.")))
    norm = lambda items: F.array_sort(F.array_distinct(F.array_compact(F.array(*items))))
    return F.struct(title.alias("title"), norm(context).alias("environmental_context"),
                    norm(risks).alias("environmental_risks"), assess.alias("irrigation_assessment"))


def spatial_narrative(intel: Column) -> Column:
    """Text appended to the decision narrative: context sentences, then the irrigation assessment."""
    ctx = F.array_join(intel["environmental_context"], " ")
    parts = F.array_compact(F.array(F.when(F.size(intel["environmental_context"]) > 0, ctx),
                                    F.when(intel["irrigation_assessment"] != "", intel["irrigation_assessment"])))
    return F.array_join(parts, " ")
