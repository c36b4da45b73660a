"""Geometry as column expressions. A point is a struct of two doubles, a ring an array of points whose last repeats the first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Fixed values of the ellipsoid and of zone 14.
AXIS, E2, SCALE, MERIDIAN = 6_378_137.0, 0.00669438, 0.9996, -99.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(half))


def utm14(lon: Column, lat: Column) -> Column:
    """A point (easting, northing) in zone 14; null where the projection isn't defined. South of the equator 10,000 km are added."""
    phi = F.radians(lat)
    second = E2 / (1 - E2)
    t, c, a = F.pow(F.tan(phi), F.lit(2)), second * F.pow(F.cos(phi), F.lit(2)), F.cos(phi) * F.radians(lon - MERIDIAN)
    radius = AXIS / F.sqrt(1 - E2 * F.pow(F.sin(phi), F.lit(2)))
    # the meridian's arc: terms in phi, sin 2 phi, sin 4 phi, sin 6 phi
    terms = (
        1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256,
        -(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024),
        15 * E2**2 / 256 + 45 * E2**3 / 1024,
        -(35 * E2**3 / 3072),
    )
    arc = AXIS * (terms[0] * phi + terms[1] * F.sin(2 * phi) + terms[2] * F.sin(4 * phi) + terms[3] * F.sin(6 * phi))
    p = lambda n: F.pow(a, F.lit(n))
    east = SCALE * radius * (a + (1 - t + c) * p(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * p(5) / 120) + 500_000
    north = SCALE * (arc + radius * F.tan(phi) * (p(2) / 2 + (5 - t + 9 * c + 4 * c * c) * p(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * p(6) / 720))
    inside = lon.between(-180, 180) & lat.between(-80, 84)
    # a term instead of two cases, which would hold all of it twice
    return F.when(inside, point(east, north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)))


def degrees_per_metre(latitude: Column) -> tuple[Column, Column]:
    """Metres per degree of latitude and of longitude at a latitude."""
    phi = F.radians(latitude)
    per_lat = 111132.92 - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi) - 0.0023 * F.cos(6 * phi)
    per_lon = 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi) + 0.118 * F.cos(5 * phi)
    return per_lat, per_lon


def metric_to_wgs84(ring: Column, center: Column, lon: Column, lat: Column) -> Column:
    """A metric ring as (lon, lat) points to 7 places, by offsets from a center known in both systems."""
    per_lat, per_lon = degrees_per_metre(lat)
    placed = lambda d: F.transform(ring, lambda p: point(F.round(lon + (p["x"] - center["x"]) / d["lon"], 7), F.round(lat + (p["y"] - center["y"]) / d["lat"], 7)))
    return let(F.struct(per_lat.alias("lat"), per_lon.alias("lon")), placed)


def capsule(center: Column, radius: Column, length: Column, azimuth: Column, segments: int = 16, digits: int = 3) -> Column:
    """The shadow of a crown: two half circles and what lies between, a closed ring; a circle where the length is 0."""
    if segments < 8 or segments % 2:
        raise ValueError("segments must be an even number of at least 8")
    m = segments // 2
    angle = F.radians(90 - azimuth)
    # what is the same for all points is computed once for each shadow
    ends = F.struct(angle.alias("angle"), center["x"].alias("x"), center["y"].alias("y"), (center["x"] + length * F.cos(angle)).alias("far_x"), (center["y"] + length * F.sin(angle)).alias("far_y"))

    def spot(x: Column, y: Column, angle: Column) -> Column:
        return point(F.round(x + radius * F.cos(angle), digits), F.round(y + radius * F.sin(angle), digits))

    def drawn(e: Column) -> Column:
        near = F.transform(F.sequence(F.lit(0), F.lit(m)), lambda i: spot(e["x"], e["y"], e["angle"] + math.pi / 2 + i * (math.pi / m)))
        far = F.transform(F.sequence(F.lit(0), F.lit(m)), lambda i: spot(e["far_x"], e["far_y"], e["angle"] - math.pi / 2 + i * (math.pi / m)))
        circle = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: spot(e["x"], e["y"], i * (2 * math.pi / segments)))
        return F.when(length == 0, circle).otherwise(F.concat(near, far))

    return let(let(ends, drawn), lambda outline: F.concat(outline, F.slice(outline, 1, 1)))


def sides(ring: Column) -> Column:
    """The sides of a ring, as structs of two points."""
    return let(ring, lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("p"), F.get(r, i + 1).alias("q"))))


def ring_area_twice(ring: Column) -> Column:
    """Twice the signed area; the ring is closed if it isn't."""
    return F.aggregate(
        F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.get(ring, (i + 1) % F.size(ring)).alias("q"))),
        F.lit(0.0),
        lambda acc, s: acc + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"],
    )


def ring_centroid(ring: Column) -> Column:
    """The centroid, or the mean of the vertices where the ring has hardly any area."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("twice", "mx", "my", "sx", "sy")])

    def add(acc: Column, s: Column) -> Column:
        p, q = s["p"], s["q"]
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        new = {"twice": cross, "mx": (p["x"] + q["x"]) * cross, "my": (p["y"] + q["y"]) * cross, "sx": p["x"], "sy": p["y"]}
        return F.struct(*[(acc[c] + v).alias(c) for c, v in new.items()])

    pairs = F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.get(ring, (i + 1) % F.size(ring)).alias("q")))
    mean = lambda t: point(t["sx"] / F.size(ring), t["sy"] / F.size(ring))
    return let(F.aggregate(pairs, zero, add), lambda t: F.when(F.abs(t["twice"]) < 1e-15, mean(t)).otherwise(point(t["mx"] / (3 * t["twice"]), t["my"] / (3 * t["twice"]))))


def largest_ring(rings: Column, least_points: int = 4) -> Column:
    """The ring with the most area, the first of equal ones; rings with too few or null points don't count."""
    good = F.filter(rings, lambda r: (F.size(r) >= least_points) & F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    ranked = F.transform(good, lambda r, i: F.struct(F.abs(ring_area_twice(r)).alias("area"), (-i).alias("first"), r.alias("ring")))
    return F.when(F.size(good) > 0, F.array_max(ranked)["ring"])


def footprint_center(rings: Column) -> Column:
    return let(largest_ring(rings), lambda best: F.when(best.isNotNull(), ring_centroid(best)))


def crossings(line_sides: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Where the line through two points meets the sides of rings, in units of the way from the first to the second, sorted.

    A side counts from its lower end to before its upper one, seen from the line, so their number is even, and inside alternates with outside.
    """

    def off(p: Column) -> Column:
        return (x1 - x0) * (p["y"] - y0) - (y1 - y0) * (p["x"] - x0)

    def along(p: Column) -> Column:
        return ((p["x"] - x0) * (x1 - x0) + (p["y"] - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))

    def meet(s: Column) -> Column:
        a, b = off(s["p"]), off(s["q"])
        return F.when((a < 0) != (b < 0), along(s["p"]) + (along(s["q"]) - along(s["p"])) * a / (a - b))

    return F.array_sort(F.array_compact(F.transform(line_sides, meet)))


def spans_inside(line_sides: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The parts of a line from 0 to 1 that lie inside of rings."""
    return let(crossings(line_sides, x0, y0, x1, y1), inside_spans)


def inside_spans(found: Column) -> Column:
    """The parts of a line from 0 to 1 that are inside, from its crossings: structs of t0 and t1, empty ones left out."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / 2).cast("int") - 1), lambda i: F.struct(F.greatest(F.get(found, 2 * i), F.lit(0.0)).alias("t0"), F.least(F.get(found, 2 * i + 1), F.lit(1.0)).alias("t1")))
    return F.when(F.size(found) < 2, F.array().cast("array<struct<t0:double,t1:double>>")).otherwise(F.filter(pairs, lambda s: s["t1"] > s["t0"]))


def bearing_error(a: Column, b: Column) -> Column:
    """Degrees between two bearings, 0 to 180."""
    apart = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(apart, 360 - apart)


def percent_error(observed: Column, predicted: Column) -> Column:
    """Null where nothing was observed."""
    return F.try_divide(F.abs(predicted - observed), observed) * 100
