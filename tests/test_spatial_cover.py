"""Point in polygon by cell cover against plain ray casting, and feature collections."""

import json
import math
import random

from terroir.operators import spatial as SP

POINT = "point_id long, lon double, lat double"
POLYGON = "feature_order long, state string, district string, ring array<struct<x: double, y: double>>"


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if min(ay, by) < y <= max(ay, by) and x <= max(ax, bx) and (ax == bx or x <= (y - ay) * (bx - ax) / (by - ay) + ax):
            odd = not odd
    return odd


def first(x, y, polygons):
    return min((order for order, _, _, ring in polygons if len(ring) > 2 and inside(x, y, ring)), default=None)


def check(spark, polygons, points, **how):
    frame = spark.createDataFrame([(o, s, d, [tuple(map(float, p)) for p in r]) for o, s, d, r in polygons], POLYGON)
    got = {r.point_id: r.feature_order for r in SP.point_in_polygon(spark.createDataFrame(points, POINT), frame, **how).collect()}
    want = {i: first(x, y, polygons) for i, x, y in points if x is not None and y is not None}
    assert got == {i: o for i, o in want.items() if o is not None}
    return SP.polygon_cover(frame, **how)


def star(n, cx, cy, rng, size):
    return [(cx + size * rng.uniform(0.2, 1) * math.cos(t * 2 * math.pi / n), cy + size * rng.uniform(0.2, 1) * math.sin(t * 2 * math.pi / n)) for t in range(n)]


def test_cover_matches_ray_casting(spark):
    rng = random.Random(4)
    polygons = [(0, "big", "star", star(300, 10, 10, rng, 3)), (1, "square", "a", [(8, 8), (16, 8), (16, 16), (8, 16), (8, 8)]),
                (2, "parts", "p", [(0, 0), (1, 0), (0, 1)]), (2, "parts", "p", [(-4, -4), (-3, -4), (-3.5, -2)]), (3, "thin", "t", [(0, 5), (30, 5.001), (0, 5.002)]),
                (4, "flat", "f", [(1, 1), (2, 2)]), (5, "none", "n", [])]
    # a dense place: many small polygons within a tenth of a degree
    polygons += [(10 + i, "dense", str(i), star(12, 12 + rng.random() / 10, 12 + rng.random() / 10, rng, 0.01)) for i in range(100)]
    points = [(i, rng.uniform(-5, 17), rng.uniform(-5, 17)) for i in range(1500)]
    points += [(2000 + i, 12 + rng.random() / 10, 12 + rng.random() / 10) for i in range(600)]
    points += [(3000 + k, float(x), float(y)) for k, (x, y) in enumerate([(8, 8), (16, 16), (8, 16), (16, 8), (12, 8), (12, 16), (0, 0), (1, 0), (16, 12), (8, 12)])]
    points += [(4000 + i, rng.uniform(0, 30), 5.001 + rng.uniform(-0.001, 0.001)) for i in range(100)] + [(5000, None, 1.0), (5001, 1.0, None)]
    cover = check(spark, polygons, points, budget=20).collect()
    sizes = [len(c.edges) for c in cover if c.level < SP.MAX_LEVEL]
    assert max(sizes) <= 20 and sum(s == 0 for s in sizes) > 50          # no cell is dense, and some need no ray cast
    assert all(c.parity == 1 for c in cover if not c.edges)
    check(spark, [], [(1, 0.0, 0.0)])


def test_feature_collection(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    far = [[10.5, 10], [11, 10], [11, 11], [10.5, 10]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1]]

    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"state": "S", "district": name, "more": 3}, "geometry": {"type": kind, "coordinates": coordinates}}

    one = [feature("point", "Point", [1, 1]), feature("a", "Polygon", [square, hole]), {"type": "Feature", "properties": None, "geometry": None},
           feature("b", "MultiPolygon", [[square], [far]])]
    (tmp_path / "1.json").write_text(json.dumps({"type": "FeatureCollection", "features": one}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("c", "Polygon", [far]), feature("empty", "Polygon", [])]}))
    got = SP.read_features(spark, str(tmp_path))
    rows = sorted((r.feature_order, r.district, r.part, [list(p) for p in r.ring]) for r in got.collect())
    assert rows == [(1, "a", 0, square), (3, "b", 0, square), (3, "b", 1, far), (4, "c", 0, far)]
    located = SP.point_in_polygon(spark.createDataFrame([(1, 1.0, 1.0), (2, 10.9, 10.5), (3, 5.0, 5.0)], POINT), got)
    assert {(r.point_id, r.district) for r in located.collect()} == {(1, "a"), (2, "b")}
    again = str(tmp_path / "out")
    SP.feature_collections(got, per_collection=2).select("value").write.text(again)
    back = sorted((r.feature_order, r.district, r.part, [list(p) for p in r.ring]) for r in SP.read_features(spark, again, multi_line=False).collect())
    assert sorted(r[1:] for r in back) == sorted(r[1:] for r in rows)
