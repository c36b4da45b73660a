"""Outlines of unions and rings with fewer points, against exact areas by slabs and plain distances."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from penumbra.operators import outlines, shadows
from penumbra.plans import shade

SIDE = "of string, p struct<x:double,y:double>, q struct<x:double,y:double>"


def around(points):
    return list(zip(points, points[1:] + points[:1], strict=True))


def covered_area(sides):
    """Area where windings add up to more than zero: between neighbouring x of corners and crossings all sides are straight and don't meet."""
    xs = {Fraction(x) for s in sides for x, _ in s}
    for ((ax, ay), (bx, by)), ((cx, cy), (dx, dy)) in itertools.combinations(sides, 2):
        down = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if down:
            t = Fraction((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), down)
            if 0 <= t <= 1:
                xs.add(ax + t * (bx - ax))
    total = Fraction(0)
    for x0, x1 in itertools.pairwise(sorted(xs)):
        x = (x0 + x1) / 2
        cuts = sorted((ay + Fraction(by - ay) * (x - ax) / (bx - ax), 1 if bx > ax else -1) for (ax, ay), (bx, by) in sides if ax != bx and min(ax, bx) < x < max(ax, bx))
        wound = 0
        for (y, sign), (above, _) in itertools.pairwise(cuts):
            wound += sign
            total += (above - y) * (x1 - x0) if wound > 0 else 0
    return float(total)


def ring_area(points):
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in itertools.pairwise(points)) / 2


def test_unions_of_random_triangles_and_boxes(spark):
    """Many share corners and sides, touch in points, or enclose holes."""
    rng, rows, want = random.Random(8), [], {}
    for k in range(30):
        sides = []
        for _ in range(rng.randint(1, 14)):
            if rng.random() < 0.5:
                x, y, w, h = rng.randint(0, 8), rng.randint(0, 8), rng.randint(1, 5), rng.randint(1, 5)
                points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            else:
                points = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(3)]
                turn = (points[1][0] - points[0][0]) * (points[2][1] - points[0][1]) - (points[1][1] - points[0][1]) * (points[2][0] - points[0][0])
                points = points if turn > 0 else points[::-1]
            sides += around(points)
        want[f"k{k}"] = covered_area(sides)
        rows += [(f"k{k}", tuple(map(float, p)), tuple(map(float, q))) for p, q in sides]
    found = outlines.dissolved(spark.createDataFrame(rows, SIDE)).withColumn("valid", shadows.valid_ring(F.col("points"))).collect()
    got = dict.fromkeys(want, 0.0)
    for r in found:
        area = ring_area([(p.x, p.y) for p in r.points])
        assert r.valid and (area < 0) == r.hole and (r.shell is not None) == r.hole
        got[r.of] += area
    assert any(r.hole for r in found)
    # every crossing may be rounded by half a millimetre
    assert all(abs(got[k] - want[k]) < 0.05 for k in want), {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 0.05}


def building(spark, rings, height=3.0):
    rows = [(1, height, [[tuple(map(float, p)) for p in [*r, r[0]]] for r in rings])]
    return spark.createDataFrame(rows, "source_id long, height_m double, footprint_m array<array<struct<x:double,y:double>>>")


def sun(spark, azimuth):
    return spark.createDataFrame([("t", 45.0, float(azimuth), True)], "bucket_start string, apparent_altitude double, shadow_azimuth double, daylight boolean")


SQUARE, YARD = [(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]


@pytest.mark.parametrize(
    "rings,height,expected",
    [
        ([[(0, 0), (2, 0), (2, 2), (0, 2)]], 3.0, [(10.0, False, {(0, 0), (5, 0), (5, 2), (0, 2)})]),
        ([SQUARE, YARD], 2.0, [(120.0, False, {(0, 0), (12, 0), (12, 10), (0, 10)}), (8.0, True, {(5, 3), (7, 3), (7, 7), (5, 7)})]),
        # the yard is longer than the shadow, and a small block stands in it
        ([SQUARE, YARD[::-1], [(4, 4), (5, 4), (5, 5), (4, 5)]], 0.5, [(105.0, False, None), (14.0, True, None), (1.5, False, {(4, 4), (5.5, 4), (5.5, 5), (4, 5)})]),
        ([SQUARE, YARD], 8.0, [(180.0, False, {(0, 0), (18, 0), (18, 10), (0, 10)})]),
    ],
)
def test_known_shadows(spark, rings, height, expected):
    found = outlines.shadow_outlines(building(spark, rings, height), sun(spark, 90)).collect()
    assert sorted((round(r.area, 6), r.hole) for r in found) == sorted((a, h) for a, h, _ in expected)
    for area, _, corners in expected:
        if corners:
            own = next(r for r in found if round(r.area, 6) == area)
            assert {(p.x, p.y) for p in own.points} == corners and len(own.points) == len(corners) + 1


def test_outlines_measure_what_lines_measure(spark, sf):
    """Each outline's area is that of the pieces, up to what lines 25 cm apart can't see; rings are valid."""
    ready, suns = shade.ready_buildings(spark, sf), shade.suns(spark)
    found = outlines.shadow_outlines(ready, suns).withColumn("valid", shadows.valid_ring(F.col("points"))).collect()
    assert all(r.valid and (ring_area([(p.x, p.y) for p in r.points]) < 0) == r.hole for r in found)
    measured = {(r.bucket_start, r.source_id): r.area_m2 for r in shadows.swept_area(shadows.building_pieces(ready, suns)).collect()}
    net = {}
    for r in found:
        net[r.bucket_start, r.source_id] = net.get((r.bucket_start, r.source_id), 0) + (-r.area if r.hole else r.area)
    assert net.keys() == measured.keys() and all(abs(net[k] - measured[k]) < 1 for k in net)


def test_no_sides_no_outlines(spark):
    assert outlines.dissolved(spark.createDataFrame([], SIDE)).count() == 0
    assert outlines.dissolved(spark.createDataFrame([("a", (1.0, 1.0), (1.0, 1.0))], SIDE)).count() == 0


RING = "id string, ring int, points array<struct<x:double,y:double>>"


def far(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])


def test_simplified_rings_stay_near_and_valid(spark):
    """Jagged circles with holes close inside them, and one that must not be touched."""
    rng, rings = random.Random(2), []
    for k in range(8):
        n = rng.randint(12, 90)
        radii = [(20 if ring == 0 else 20 - 0.35 - 4 * ring, ring) for ring in range(3)]
        for radius, ring in radii:
            points = [(round((radius + rng.uniform(-0.12, 0.12)) * math.cos(2 * math.pi * i / n), 3), round((radius + rng.uniform(-0.12, 0.12)) * math.sin(2 * math.pi * i / n), 3)) for i in range(n)]
            rings.append((f"k{k}", ring, [*points, points[0]]))
    # two rings a hand apart: a shortcut of the outer one would cut through the inner one's corner
    rings += [("near", 0, [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (5.0, 5.2), (0.0, 5.0), (0.0, 0.0)]), ("near", 1, [(4.9, 5.1), (5.1, 5.1), (5.0, 5.15), (4.9, 5.1)])]
    rings += [("triangle", 0, [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1), (0.0, 0.0)])]
    df = spark.createDataFrame(rings, RING)
    got = {(r.id, r.ring): r for r in outlines.simplified(df).withColumn("valid", shadows.valid_ring(F.col("points"))).collect()}
    assert len(got) == len(rings)
    fewer = 0
    for k, ring, points in rings:
        r = got[k, ring]
        kept = [(p.x, p.y) for p in r.points]
        assert r.valid and set(kept) <= set(points) and kept[0] == kept[-1]
        assert all(min(far(p, a, b) for a, b in itertools.pairwise(kept)) <= 0.25 + 1e-9 for p in points)
        fewer += len(points) - len(kept)
    assert fewer > len(rings) * 10 and len(got["near", 0].points) == 6 and len(got["triangle", 0].points) == 4

    def crossing(s, t):
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return turn(*s, t[0]) * turn(*s, t[1]) < 0 and turn(*t, s[0]) * turn(*t, s[1]) < 0

    for k in {r[0] for r in rings}:
        sides = [s for (i, _), r in got.items() if i == k for s in itertools.pairwise([(p.x, p.y) for p in r.points])]
        assert not any(crossing(s, t) for s, t in itertools.combinations(sides, 2))
