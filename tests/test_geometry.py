"""Cells of polygons and distances to outlines against brute force."""

import math
import random

import pytest

from tidemark.operators import detectors as d
from tidemark.operators import geometry as g

RINGS = "array<array<struct<x: double, y: double>>>"


def held(x, y, rings):
    """Even-odd by a ray to the right."""
    inside = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def segments(rings):
    return [s for r in rings for s in zip(r, r[1:])]


def nearest(x, y, rings, plane=False):
    """Metres (or degrees on a plane) to the nearest segment."""
    best, scale = math.inf, 1.0 if plane else math.cos(math.radians(y))
    for (x1, y1), (x2, y2) in segments(rings):
        dx, dy = (x2 - x1) * scale, y2 - y1
        at = ((x - x1) * scale * dx + (y - y1) * dy) / (dx * dx + dy * dy) if dx or dy else 0.0
        t = min(max(at, 0.0), 1.0)
        qx, qy = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        if plane:
            best = min(best, math.hypot(x - qx, y - qy))
            continue
        a = math.sin(math.radians(qy - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(qy)) * math.sin(math.radians(qx - x) / 2) ** 2
        best = min(best, 2 * 6_371_000 * math.asin(math.sqrt(min(a, 1.0))))
    return best


def star(rng, cx, cy, r, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + rng.uniform(0.3, 1) * r * math.cos(a), cy + rng.uniform(0.3, 1) * r * math.sin(a)) for a in turns]
    return ring + ring[:1]


def square(low, high):
    return [(low, low), (high, low), (high, high), (low, high), (low, low)]


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(8)
    out = {i: [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.5, 3, 15]), rng.choice([3, 8, 60]))] for i in range(12)}
    out[12] = [square(0.0, 10.0), square(2.0, 8.0), square(4.0, 6.0)]  # a hole with an island, sides on cell borders
    out[13] = [[(-30.0, -1.0), (30.0, 1.0), (30.0, 1.2), (-30.0, -1.0)]]  # long and thin
    out[14], out[15] = [], [[(1.0, 1.0), (1.0, 1.0)]]  # nothing
    return out


def frames(spark, shapes, points):
    land = spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, rings in shapes.items()], f"polygon long, rings {RINGS}")
    return land, spark.createDataFrame(points, "id long, x double, y double, polygon string, cx int, edges int")


def points(rng, n, lines=True):
    out = [(i, rng.uniform(-25, 25), rng.uniform(-25, 25)) for i in range(n)]
    out += [(n + i, float(rng.randrange(-5, 12)), float(rng.randrange(-5, 12))) for i in range(120)] if lines else []
    return [(*p, "a", 0, 0) for p in out] + [(9001, None, 1.0, "", 0, 0), (9002, float("nan"), 1.0, "", 0, 0), (9003, 1.0, None, "", 0, 0)]


@pytest.mark.parametrize("cell", [0.7, 2.0, 50.0])
def test_points_in_cells_equal_rays(spark, shapes, cell):
    own = points(random.Random(1), 500)
    land, df = frames(spark, shapes, own)
    found = g.points_in_polygons(df, g.polygon_edges(land, "polygon", "rings"), "id", "x", "y", "polygon", cell)
    want = {(p[0], i) for p in own if p[0] < 9000 for i, rings in shapes.items() if held(p[1], p[2], rings)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_only_points_well_inside_and_only_cells_of_a_box(spark, shapes):
    own = points(random.Random(2), 400, lines=False)
    land, df = frames(spark, shapes, own)
    edges, box = g.polygon_edges(land, "polygon", "rings"), (-10.0, -12.0, 11.0, 9.0)
    tiled = g.tiles(edges, "polygon", 1.0, 0.4, box)
    assert tiled.where("cx < -12 or cx > 9 or cy < -10 or cy > 11").count() == 0
    found = g.points_in_tiles(df, tiled, "id", "x", "y", "polygon", 1.0, 0.4)
    want = {(p[0], i) for p in own if p[0] < 9000 and -12 <= p[1] < 10 and -10 <= p[2] < 12 for i, rings in shapes.items() if held(p[1], p[2], rings) and nearest(p[1], p[2], rings, plane=True) > 0.4}
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("cell, reach", [(0.3, 400_000.0), (5.0, 1_500_000.0), (4.0, 100_000.0)])
def test_nearest_segment_equals_brute_force(spark, shapes, cell, reach):
    some = {i: shapes[i] for i in (0, 3, 12, 13, 14, 15)}
    own = points(random.Random(3), 150)
    land, df = frames(spark, some, own + own[:5])
    got = g.nearest_outline(df, g.polygon_edges(land, "polygon", "rings"), "id", "y", "x", cell, reach).collect()
    assert len(got) == len(own) + 5
    for r in got:
        if r.id > 9000:
            assert r.distance_m is None
            continue
        _, x, y, *_ = own[r.id]
        want = min(nearest(x, y, rings) for rings in some.values() if rings)
        assert r.distance_m is None if want > reach else abs(r.distance_m - want) < 1e-3
    assert g.nearest_outline(df.limit(0), g.polygon_edges(land, "polygon", "rings"), "id", "y", "x", cell, reach).collect() == []


def test_grid_of_land_and_coastal_cells(spark):
    rings = [square(0.0, 1.0), square(0.3, 0.7)]
    land, _ = frames(spark, {1: rings}, [(0, 0.0, 0.0, "", 0, 0)])
    grid = {(r.lat_i, r.lon_i): r for r in g.land_distance_grid(land, (-1.0, -1.0, 2.0, 2.0), 0.1, 30.0).collect()}
    assert len(grid) == 900
    for (i, j), r in grid.items():
        y, x = -1 + (i + 0.5) * 0.1, -1 + (j + 0.5) * 0.1
        assert r.on_land == held(x, y, rings)
        assert abs(r.dist_land_km - (0.0 if r.on_land else min(nearest(x, y, rings) / 1000, 30.0))) < 1e-6
    cells = spark.createDataFrame([(0.1, 0.1, 0.15, 0.15), (1.05, 0.5, 1.055, 0.505), (1.5, 1.5, 1.55, 1.55)], "cell_lat double, cell_lon double, center_latitude double, center_longitude double")
    got = {r.cell_lat: r for r in d.coastal_flag(cells, land).collect()}
    assert (got[0.1].is_coastal, got[0.1].distance_to_land_m) == (True, 0.0)
    assert got[1.05].is_coastal and abs(got[1.05].distance_to_land_m - 0.055 * 111_194.93) < 1
    assert (got[1.5].is_coastal, got[1.5].distance_to_land_m) == (False, None)
