"""Shadows of trees and buildings at given instants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.functions.solar import shadow_length

CAP_M = 100.0


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
    return F.coalesce(out, F.lit(False))


def tree_throws() -> Column:
    """Whether a normalised tree throws a shadow: ready, with a point in range and a height and radius above zero."""
    lon, lat = F.col("point_wgs84.x"), F.col("point_wgs84.y")
    return F.coalesce(
        F.col("shade_ready") & F.col("source_id").isNotNull() & F.col("point_m").isNotNull() & lon.between(-180, 180) & lat.between(-90, 90) & (F.col("height_m") > 0) & (F.col("height_m") < math.inf) & (F.col("canopy_radius_m") > 0) & (F.col("canopy_radius_m") < math.inf),
        F.lit(False),
    )


def eligible_trees(trees: DataFrame) -> DataFrame:
    """Normalised trees that throw a shadow. Repeated ids stay."""
    return trees.filter(tree_throws())


def without_repeats(ring: Column) -> Column:
    """A ring's points without those equal to the point before."""
    return geo.let(ring, lambda r: F.filter(r, lambda p, i: (i == 0) | ~F.get(r, i - 1).eqNullSafe(p)))


def crosses_itself(ring: Column) -> Column:
    """Whether sides of a closed ring without repeated points meet anywhere but at the corner between two that follow one another, or run back over one another."""

    def turn(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def on(a: Column, b: Column, c: Column) -> Column:
        return (turn(a, b, c) == 0) & c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def meet(s: Column, t: Column) -> Column:
        a, b, c, d = s["p"], s["q"], t["p"], t["q"]
        across = (F.signum(turn(a, b, c)) * F.signum(turn(a, b, d)) < 0) & (F.signum(turn(c, d, a)) * F.signum(turn(c, d, b)) < 0)
        return across | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)

    def back(s: Column, t: Column) -> Column:
        ahead = (s["q"]["x"] - s["p"]["x"]) * (t["q"]["x"] - t["p"]["x"]) + (s["q"]["y"] - s["p"]["y"]) * (t["q"]["y"] - t["p"]["y"])
        return (turn(s["p"], s["q"], t["q"]) == 0) & (ahead < 0)

    def any_two(numbered: Column) -> Column:
        n = F.size(numbered)

        def wrong(s: Column, t: Column) -> Column:
            return F.when(t["i"] == s["i"] + 1, back(s, t)).when((s["i"] == 0) & (t["i"] == n - 1), back(t, s)).otherwise(meet(s, t))

        return F.exists(numbered, lambda s: F.exists(F.slice(numbered, s["i"] + 2, n), lambda t: wrong(s, t)))

    return geo.let(F.transform(geo.sides(ring), lambda s, i: F.struct(s["p"].alias("p"), s["q"].alias("q"), i.alias("i"))), any_two)


def valid_ring(ring: Column) -> Column:
    """Four points or more, all finite, closed, with three distinct corners, some area, and no side that meets another; points repeated in a row count once."""

    def good(r: Column) -> Column:
        near = F.transform(r, lambda p: geo.point(p["x"] - r[0]["x"], p["y"] - r[0]["y"]))
        closed = (F.element_at(r, -1)["x"] == r[0]["x"]) & (F.element_at(r, -1)["y"] == r[0]["y"])
        whole = F.forall(r, lambda p: finite(p["x"], p["y"])) & closed & (F.size(F.array_distinct(r)) >= 3) & (F.abs(geo.ring_area_twice(near)) > 0)
        return F.when(F.size(r) < 4, F.lit(False)).when(~whole, F.lit(False)).otherwise(~crosses_itself(near))

    return F.when(F.size(ring) < 4, F.lit(False)).otherwise(F.coalesce(geo.let(without_repeats(ring), good), F.lit(False)))


def valid_reference(footprint_m: Column, footprint_wgs84: Column) -> Column:
    """Whether a footprint's first point is finite in metres and on the globe in degrees: drawings are placed by it."""
    m, w = footprint_m[0][0], footprint_wgs84[0][0]
    return F.coalesce(finite(m["x"], m["y"], w["x"], w["y"]) & w["x"].between(-180, 180) & w["y"].between(-90, 90), F.lit(False))


def eligible_buildings(buildings: DataFrame) -> DataFrame:
    """Normalised buildings (with pos, their order) that throw a shadow; of those with one id the first that qualifies."""
    height = F.col("estimated_height_m")
    # both footprints are named once, since the plan repeats what they are computed from for each naming
    footprint = F.struct(F.col("footprint_m").alias("m"), F.col("footprint_wgs84").alias("w"))
    sound = geo.let(footprint, lambda f: (F.size(f["m"]) > 0) & F.forall(f["m"], valid_ring) & valid_reference(f["m"], f["w"]))
    good = buildings.filter(F.col("shade_ready") & F.col("source_id").isNotNull() & finite(height) & (height > 0) & sound)
    first = F.row_number().over(W.partitionBy("source_id").orderBy("pos"))
    return good.withColumn("n", first).filter("n = 1").drop("n").withColumn("height_m", height)


def ring_depths(rings: DataFrame) -> DataFrame:
    """rings: id, ring (its number), points. Adds area, depth (how many larger rings of the same id hold it), hole, and shell: for holes the smallest even ring around.

    Rings of one id meet in a join on the id; a ring is inside another if its first side's middle, moved a little inward, is.
    """
    def inner(p: Column) -> Column:
        a, b = p[0], p[1]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        near = F.transform(p, lambda q: geo.point(q["x"] - a["x"], q["y"] - a["y"]))
        turn = F.signum(geo.ring_area_twice(near))
        return geo.point((a["x"] + b["x"]) / 2 - turn * dy * 1e-6, (a["y"] + b["y"]) / 2 + turn * dx * 1e-6)

    measured = rings.select("id", "ring", "points", F.abs(geo.ring_area_twice(F.transform("points", lambda p: geo.point(p["x"] - F.col("points")[0]["x"], p["y"] - F.col("points")[0]["y"]))) / 2).alias("area"), inner(F.col("points")).alias("spot"))
    other = measured.select("id", F.col("ring").alias("outer"), F.col("points").alias("around"), F.col("area").alias("outer_area"))
    spot = F.col("spot")
    crossed = F.aggregate(
        geo.sides(F.col("around")), F.lit(0),
        lambda n, s: n + F.when(((s["p"]["y"] > spot["y"]) != (s["q"]["y"] > spot["y"])) & (spot["x"] < (s["q"]["x"] - s["p"]["x"]) * (spot["y"] - s["p"]["y"]) / (s["q"]["y"] - s["p"]["y"]) + s["p"]["x"]), 1).otherwise(0),
    )
    held = measured.join(other, "id").filter((F.col("outer_area") > F.col("area")) & (crossed % 2 == 1)).groupBy("id", "ring").agg(F.count(F.lit(1)).alias("depth"), F.array_sort(F.collect_list(F.struct("outer_area", "outer"))).alias("outers"))
    depths = measured.join(held.select("id", "ring", "depth"), ["id", "ring"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    even = depths.filter("depth % 2 = 0").select("id", F.col("ring").alias("shell"))
    around = held.select("id", "ring", F.posexplode("outers").alias("n", "o")).select("id", "ring", F.col("o.outer").alias("shell"), F.col("o.outer_area").alias("a"))
    shells = around.join(even, ["id", "shell"]).groupBy("id", "ring").agg(F.min_by("shell", F.struct("a", "shell")).alias("shell"))
    hole = F.col("depth") % 2 == 1
    return depths.join(shells, ["id", "ring"], "left").select("id", "ring", "points", "area", F.col("depth").cast("long").alias("depth"), hole.alias("hole"), F.when(hole, F.col("shell")).alias("shell"))


def by_instant(features: DataFrame, suns: DataFrame) -> DataFrame:
    """Each feature at each instant at which the sun is up. suns: bucket_start, apparent_altitude, shadow_azimuth, daylight, a row per instant asked for.

    The instants are the caller's list, which bounds what is broadcast; features are never moved.
    """
    lit = suns.filter("daylight").select("bucket_start", "apparent_altitude", "shadow_azimuth")
    return features.crossJoin(F.broadcast(lit)).withColumn("reach", shadow_length(F.col("height_m"), F.col("apparent_altitude"), CAP_M)).withColumn("capped", F.coalesce(F.try_divide(F.col("height_m"), F.tan(F.radians("apparent_altitude"))) > CAP_M, F.lit(True)))


def tree_shadows(trees: DataFrame, suns: DataFrame, segments: int = 16) -> DataFrame:
    """bucket_start, source_id, length_m (3 places), length_capped, polygon (metric, 3 places) for eligible trees."""
    shaped = by_instant(eligible_trees(trees), suns)
    polygon = geo.capsule(F.col("point_m"), F.col("canopy_radius_m"), F.col("reach"), F.col("shadow_azimuth"), segments)
    return shaped.select("bucket_start", "source_id", F.round("reach", 3).alias("length_m"), F.col("capped").alias("length_capped"), polygon.alias("polygon"), "point_m", "point_wgs84", "canopy_radius_m", "shadow_azimuth")


def tree_shadow_map(trees: DataFrame, suns: DataFrame, segments: int = 8) -> DataFrame:
    """As tree_shadows, drawn with fewer points from the rounded length, in degrees."""
    shaped = by_instant(eligible_trees(trees), suns)
    ring = geo.capsule(F.col("point_m"), F.col("canopy_radius_m"), F.round("reach", 3), F.col("shadow_azimuth"), segments)
    return shaped.select("bucket_start", "source_id", geo.metric_to_wgs84(ring, F.col("point_m"), F.col("point_wgs84.x"), F.col("point_wgs84.y")).alias("ring"))


def offset(reach: Column, azimuth: Column) -> tuple[Column, Column]:
    """How far a shadow's tip lies east and north; less than 1e-12 is nothing."""
    trim = lambda v: F.when(F.abs(v) < 1e-12, 0.0).otherwise(v)
    return trim(reach * F.sin(F.radians(azimuth))), trim(reach * F.cos(F.radians(azimuth)))


def building_pieces(buildings: DataFrame, suns: DataFrame) -> DataFrame:
    """The parts whose union is a building's shadow: bucket_start, source_id, shadow_azimuth, piece, sides.

    Piece -2 is the footprint, -1 the footprint moved to the shadow's end, the others are what single sides sweep; parts without area are left out.
    """
    shaped = by_instant(buildings, suns)
    dx, dy = offset(F.col("reach"), F.col("shadow_azimuth"))
    shaped = shaped.withColumn("dx", dx).withColumn("dy", dy).withColumn("own", F.flatten(F.transform("footprint_m", geo.sides)))
    moved = lambda p: geo.point(p["x"] + F.col("dx"), p["y"] + F.col("dy"))
    there = F.transform("own", lambda s: F.struct(moved(s["p"]).alias("p"), moved(s["q"]).alias("q")))

    def quad(s: Column) -> Column:
        corners = F.array(s["p"], s["q"], moved(s["q"]), moved(s["p"]), s["p"])
        return geo.sides(corners)

    swept = F.filter("own", lambda s: F.abs((s["q"]["x"] - s["p"]["x"]) * F.col("dy") - (s["q"]["y"] - s["p"]["y"]) * F.col("dx")) > 1e-9)
    return shaped.select("bucket_start", "source_id", "shadow_azimuth", F.posexplode_outer(F.concat(F.array(F.col("own"), there), F.transform(swept, quad))).alias("piece", "sides")).withColumn("piece", F.col("piece") - 2)


def _area_by_lines(step: float):
    """A function of a building's sides (number of the piece, both ends): the area of the union of the pieces by lines `step` metres apart, null where no line meets one."""

    def one(piece, x1, y1, x2, y2) -> float | None:
        # each side with the lines around it, of which those stay that pass between its ends
        first = np.floor(np.minimum(y1, y2) / step).astype(np.int64) - 1
        many = np.floor(np.maximum(y1, y2) / step).astype(np.int64) + 2 - first
        side = np.repeat(np.arange(len(piece)), many)
        line = np.arange(len(side)) - np.repeat(np.cumsum(many) - many, many) + first[side]
        y = (line + 0.5) * step
        hit = (y1[side] < y) != (y2[side] < y)
        side, line, y = side[hit], line[hit], y[hit]
        if not len(side):
            return None
        x = x1[side] + (x2[side] - x1[side]) * (y - y1[side]) / (y2[side] - y1[side])
        # along a line a piece begins and ends in turn
        order = np.lexsort((x, piece[side], line))
        x, line = x[order], line[order]
        turn = np.where(np.arange(len(x)) % 2 == 0, 1, -1)
        order = np.lexsort((x, line))
        within = np.cumsum(turn[order])[:-1] > 0
        return float(np.diff(x[order])[within].sum() * step)

    @F.pandas_udf("double")
    def area(piece: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(piece, x1, y1, x2, y2, strict=True)], dtype="float64")

    # said to vary, so that a filter on it isn't moved below and doesn't measure all twice
    return area.asNondeterministic()


def swept_area(pieces: DataFrame, step: float = 0.25) -> DataFrame:
    """bucket_start, source_id, area_m2 of the union of each building's pieces: lengths inside of any piece on lines `step` metres apart, times step.

    A building's sides at one instant come together as one row, no larger than a few times its footprint. Its lines are measured where that row is: there are no rows for lines.
    """
    keys = ["bucket_start", "source_id"]
    numbered = F.transform("sides", lambda s: F.struct(F.col("piece").alias("piece"), s["p"]["x"].alias("x1"), s["p"]["y"].alias("y1"), s["q"]["x"].alias("x2"), s["q"]["y"].alias("y2")))
    whole = pieces.groupBy(*keys).agg(F.flatten(F.collect_list(numbered)).alias("sides"))
    area = _area_by_lines(step)(*[F.col(f"sides.{c}") for c in ("piece", "x1", "y1", "x2", "y2")])
    # buildings that no line meets have no row
    return whole.select(*keys, area.alias("area_m2")).filter("area_m2 is not null")
