"""Boxes and polygons by cells against a loop over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import spatial

RINGS = "polygon_id int, rings array<array<struct<x:double,y:double>>>"
BOXES = "box_id int, bbox array<double>"


def slow_meets(rings, box):
    """Even-odd inside at the box's corners and middle, a vertex in the box, or an edge that crosses a side."""
    w, s, e, n = box
    edges = [(a, b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if len(r) > 2]

    def inside(x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2 == 1

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def cross(a, b, c, d):
        if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
            return False
        return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0

    if any(w <= a[0] <= e and s <= a[1] <= n for a, _ in edges) or inside(w, s):
        return True
    corners = [(w, s), (e, s), (e, n), (w, n)]
    return any(cross(a, b, c, d) for a, b in edges for c, d in zip(corners, [*corners[1:], corners[0]], strict=True))


def pieces(box):
    if box is None or box[1] > box[3]:
        return []
    w, s, e, n = box
    return [box] if w <= e else [(w, s, 180.0, n), (-180.0, s, e, n)]


def star(r, x, y, size, corners):
    out = []
    for k in range(corners):
        far = size * r.uniform(0.3, 1)
        out.append((x + far * math.cos(2 * math.pi * k / corners), y + far * math.sin(2 * math.pi * k / corners)))
    return out


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(20)
    out = []
    for k in range(120):
        x, y, size = r.uniform(-175, 175), r.uniform(-80, 80), r.choice([0.5, 3, 20, 60])
        rings = [star(r, x, y, size, r.randint(3, 12))]
        if k % 3 == 0:
            rings.append(star(r, x, y, size * 0.2, 5))  # a hole
        if k % 4 == 0:
            rings.append(star(r, x + 2.5 * size, y, size / 2, 6))  # another part
        if k % 10 == 0:
            rings.append([(x, y), (x + size, y + size), (x + size, y), (x, y + size)])  # crosses itself
        out.append((k, rings))
    return out


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(21)
    out = []
    for k in range(600):
        x, y = (r.uniform(-180, 170), r.uniform(-88, 80)) if k % 3 else (10 + r.random(), 45 + r.random())
        out.append((k, (x, y, min(180.0, x + r.choice([0.0, 0.1, 1, 8])), y + r.choice([0.0, 0.1, 1, 6]))))
    return out + [(600, None), (601, (175.0, -10.0, -175.0, 10.0)), (602, (-180.0, -90.0, 180.0, 90.0)), (603, (0.0, 10.0, 5.0, 5.0)), (604, (179.0, 80.0, -179.0, 90.0))]


def frames(spark, boxes, shapes):
    listed = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in shapes]
    return spark.createDataFrame([(k, list(b) if b else None) for k, b in boxes], BOXES).repartition(3), spark.createDataFrame(listed, RINGS).repartition(2)


def test_cells_against_all_pairs(spark, boxes, shapes):
    left, right = frames(spark, boxes, shapes)
    want = sorted((i, k) for i, b in boxes for k, rings in shapes if any(slow_meets(rings, p) for p in pieces(b)))
    assert len(want) > 500
    assert sorted(map(tuple, spatial.boxes_in_polygons(left, right).collect())) == want
    found = spatial.boxes_in_polygons(left, right, hot=60)  # a third of all boxes share a cell: it is cut again and again
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_holes_parts_and_repair(spark):
    square = lambda x, y, side: [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    frame = [square(0, 0, 10), square(2, 2, 6)]
    boxes = [(1, (3, 3, 4, 4)), (2, (1, 1, 1.5, 1.5)), (3, (7.5, 7.5, 9, 9)), (4, (20, 20, 21, 21)), (5, (-5, -5, 30, 30)), (6, (10, 3, 12, 4)), (7, (10.1, 3, 12, 4))]
    shapes = [
        (1, frame), (2, [*frame, square(20.2, 20.2, 0.1)]), (3, [square(0, 0, 10) + [(0, 0)], [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0)]]),
        (4, []), (5, [[(0.0, 0.0)]]), (6, [[(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]]),
    ]
    left, right = frames(spark, [(k, tuple(map(float, b))) for k, b in boxes], [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in shapes])
    got = sorted(map(tuple, spatial.boxes_in_polygons(left, right).collect()))
    assert [k for k, p in got if p == 1] == [2, 3, 5, 6] and [k for k, p in got if p == 2] == [2, 3, 4, 5, 6]
    assert [k for k, p in got if p == 3] == [1, 2, 3, 5, 6] and not [k for k, p in got if p in (4, 5)]
    assert [k for k, p in got if p == 6] == [1, 2, 3, 5, 6]  # the two triangles of a bow tie, with the edge they share
    odd = right.where("polygon_id = 1").select("polygon_id", F.array(F.lit(None).cast("array<struct<x:double,y:double>>"), F.concat(F.get("rings", F.lit(0)), F.array(F.struct(F.lit(None).cast("double").alias("x"), F.lit(1.0).alias("y"))))).alias("rings"))
    assert sorted(r.box_id for r in spatial.boxes_in_polygons(left, odd).collect()) == [1, 2, 3, 5, 6]
    assert spatial.boxes_in_polygons(left.limit(0), right).count() == 0 and spatial.boxes_in_polygons(left, right.limit(0)).count() == 0


def test_scenes_inside_a_place_of_parts_and_holes(spark, boxes, shapes):
    """The evidence path's filter takes a place of several rings; scenes without a box are outside."""
    from tilewright.operators import evidence, request

    _, places = frames(spark, boxes, shapes)
    scenes = spark.createDataFrame([(str(k), None, list(b) if b else None) for k, b in boxes], "tile_id string, timestamp timestamp, bbox array<double>")
    query = request.Query("flood", "x", place_name="p", place_level="country", resolved_place_id="p")
    for k in (0, 3, 12, 20):
        found = evidence.matching(query, places.where(F.col("polygon_id") == k).select("rings"), scenes, True)
        assert found.columns == scenes.columns
        want = sorted(i for i, b in boxes if any(slow_meets(shapes[k][1], p) for p in pieces(b)))
        assert sorted(int(r.tile_id) for r in found.collect()) == want
