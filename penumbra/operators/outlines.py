"""Outlines: the rings around the union of many overlapping polygons, and rings with fewer points.

The union is a planar overlay said as relations. Sides lie on a grid of millimetres. They are cut wherever they pass a corner or a crossing of others, so that parts of sides meet
at their ends alone; equal parts become one row with a net direction; a part's two sides are open or covered as the winding numbers there say, which are sums
over the parts to its west; parts with one open and one covered side are the outline, and chains of them are its rings.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from penumbra.functions import geo
from penumbra.operators.graph import kept
from penumbra.operators.shadows import by_instant, offset, ring_depths

#: Millimetres: the size of cells in which sides meet, and the height of strips in which parts are counted.
CELL, STRIP = 32_000, 4_000


def oriented(rings: DataFrame) -> DataFrame:
    """id, rings: of each id's rings (id, ring, points), those that enclose ground run counterclockwise, holes clockwise. Repeated points and order of rings stay."""
    known = ring_depths(rings)
    # seen from a ring's own first point, so that large coordinates cost no digits
    near = F.transform("points", lambda p: geo.point(p["x"] - F.col("points")[0]["x"], p["y"] - F.col("points")[0]["y"]))
    turned = F.when((geo.ring_area_twice(near) > 0) == F.col("hole"), F.reverse("points")).otherwise(F.col("points"))
    return known.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", turned.alias("points")))), lambda r: r["points"]).alias("rings"))


def swept_sides(buildings: DataFrame, suns: DataFrame) -> DataFrame:
    """of (bucket_start, source_id), p, q: directed sides whose windings, added up, are above zero on exactly the ground that a building or its shadow covers."""
    rings = buildings.select(F.col("source_id").alias("id"), F.posexplode("footprint_m").alias("ring", "points"))
    turned = oriented(rings).select(F.col("id").alias("source_id"), "rings")
    shaped = by_instant(buildings.select("source_id", "height_m").join(turned, "source_id"), suns)
    dx, dy = offset(F.col("reach"), F.col("shadow_azimuth"))
    shaped = shaped.withColumn("dx", dx).withColumn("dy", dy).withColumn("own", F.flatten(F.transform("rings", geo.sides)))
    moved = lambda p: geo.point(p["x"] + F.col("dx"), p["y"] + F.col("dy"))
    side = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    turn = lambda s: (s["q"]["x"] - s["p"]["x"]) * F.col("dy") - (s["q"]["y"] - s["p"]["y"]) * F.col("dx")

    def quad(s: Column) -> Column:
        around = F.array(side(s["p"], s["q"]), side(s["q"], moved(s["q"])), side(moved(s["q"]), moved(s["p"])), side(moved(s["p"]), s["p"]))
        return F.when(turn(s) > 0, around).otherwise(F.transform(around, lambda x: side(x["q"], x["p"])))

    there = F.transform("own", lambda s: side(moved(s["p"]), moved(s["q"])))
    swept = F.flatten(F.transform(F.filter("own", lambda s: F.abs(turn(s)) > 1e-9), quad))
    return shaped.select(F.struct("bucket_start", "source_id").alias("of"), F.explode(F.concat("own", there, swept)).alias("s")).select("of", "s.p", "s.q")


_ENDS = ["ux", "uy", "vx", "vy"]


def _summed(directed: DataFrame) -> DataFrame:
    """of, u, v, net: equal and opposite parts (of, a, b, times) as one row from the lesser end to the greater; those that cancel drop out, as do points."""
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    flip = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    ends = [flip("ax", "bx").alias("ux"), flip("ay", "by").alias("uy"), flip("bx", "ax").alias("vx"), flip("by", "ay").alias("vy")]
    rows = directed.filter("ax <> bx or ay <> by").select("of", *ends, F.when(forward, F.col("times")).otherwise(-F.col("times")).alias("times"))
    return rows.groupBy("of", *_ENDS).agg(F.sum("times").alias("net")).filter("net <> 0")


def _in_cells(rows: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: int = CELL) -> DataFrame:
    """rows once for each cell of their box."""
    reach = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return rows.withColumn("cx", F.explode(reach(x0, x1))).withColumn("cy", F.explode(reach(y0, y1)))


def _parts(sides: DataFrame) -> DataFrame:
    """Sides (of, u, v, net) cut at all corners and crossings, rounded to the grid: of, u, v, net of parts that meet at ends alone.

    A crossing is rounded to a whole millimetre, and every side that passes within that square is led through its middle: so rounding makes no new crossings.
    """
    c = F.col
    placed = kept(_in_cells(sides, c("ux") - 1, F.least("uy", "vy") - 1, c("vx") + 1, F.greatest("uy", "vy") + 1), "sides")
    other = placed.select("of", "cx", "cy", *[c(x).alias(f"o{x}") for x in _ENDS])

    def turn(ax, ay, bx, by, px, py):
        return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    s, t = [c(x) for x in _ENDS], [c(f"o{x}") for x in _ENDS]
    a, b = turn(*t, s[0], s[1]), turn(*t, s[2], s[3])
    d, e = turn(*s, t[0], t[1]), turn(*s, t[2], t[3])
    apart = (F.struct(*_ENDS) < F.struct(*[f"o{x}" for x in _ENDS])) & (F.signum(a) * F.signum(b) < 0) & (F.signum(d) * F.signum(e) < 0)
    way = F.try_divide(a, a - b)
    spot = lambda p, q: F.round(p + way * (q - p)).cast("long")
    crossed = placed.join(other, ["of", "cx", "cy"]).filter(apart).select("of", spot(s[0], s[2]).alias("x"), spot(s[1], s[3]).alias("y"))
    ends = sides.select("of", F.explode(F.array(F.struct(c("ux").alias("x"), c("uy").alias("y")), F.struct(c("vx").alias("x"), c("vy").alias("y")))).alias("p")).select("of", "p.x", "p.y")
    spots = crossed.unionByName(ends).distinct().withColumn("cx", F.floor(c("x") / CELL)).withColumn("cy", F.floor(c("y") / CELL))
    # the square around a spot is met if its corners don't all lie on one side, and the boxes overlap
    dx, dy, x, y = s[2] - s[0], s[3] - s[1], c("x"), c("y")
    inside = (F.abs(2 * turn(*s, x, y)) <= F.abs(dx) + F.abs(dy)) & x.between(s[0], s[2]) & y.between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))
    met = placed.join(spots, ["of", "cx", "cy"]).filter(inside)
    along = (x - s[0]) * dx + (y - s[1]) * dy
    order = W.partitionBy("of", *_ENDS).orderBy(along, x, y)
    linked = met.select("of", *_ENDS, "net", "x", "y").withColumns({"bx": F.lead("x").over(order), "by": F.lead("y").over(order)}).filter("bx is not null")
    return _summed(linked.select("of", x.alias("ax"), y.alias("ay"), "bx", "by", c("net").alias("times")))


def _outline(parts: DataFrame) -> DataFrame:
    """of, a, b: the parts with covered ground on their left and open ground on their right."""
    c = F.col
    parts = kept(parts, "parts")
    # twice the middle's coordinates, so that all is in whole numbers
    seen = parts.withColumns({"mx": c("ux") + c("vx"), "my": c("uy") + c("vy"), "strip": F.floor((c("uy") + c("vy")) / 2 / STRIP)})
    low, high = F.least("uy", "vy"), F.greatest("uy", "vy")
    steep = parts.filter("uy <> vy").withColumn("strip", F.explode(F.sequence(F.floor(low / STRIP), F.floor(high / STRIP)))).select("of", "strip", *[c(x).alias(f"o{x}") for x in _ENDS], c("net").alias("onet"))
    level = c("uy") == c("vy")
    above = lambda y: F.when(level, 2 * c(y) >= c("my")).otherwise(2 * c(y) > c("my"))
    up = F.when(c("ovy") > c("ouy"), 1).otherwise(-1)
    # west of the middle: left of it for a part that goes up, right of it for one that goes down
    side = (c("ovx") - c("oux")) * (c("my") - 2 * c("ouy")) - (c("ovy") - c("ouy")) * (c("mx") - 2 * c("oux"))
    west = (above("ouy") != above("ovy")) & (side * up < 0)
    counted = seen.join(steep, ["of", "strip"]).filter(west & ~F.struct(*_ENDS).eqNullSafe(F.struct(*[f"o{x}" for x in _ENDS]))).groupBy("of", *_ENDS).agg(F.sum(-up * c("onet")).alias("wound"))
    known = parts.join(counted, ["of", *_ENDS], "left").withColumn("wound", F.coalesce("wound", F.lit(0)))
    rising = c("vy") > c("uy")
    known = known.withColumn("left", F.when(rising, c("wound")).otherwise(c("wound") + c("net"))).withColumn("right", F.when(rising, c("wound") - c("net")).otherwise(c("wound")))
    edge = known.filter("(left > 0) <> (right > 0)")
    ahead = c("left") > 0
    flip = lambda x, y: F.when(ahead, c(x)).otherwise(c(y))
    return edge.select("of", flip("ux", "vx").alias("ax"), flip("uy", "vy").alias("ay"), flip("vx", "ux").alias("bx"), flip("vy", "uy").alias("by"))


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _rings(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    """Directed parts in rings: numbers of the parts at whose beginnings a ring has its corners, corners on a straight way left out.

    Where several parts go on from a point, the way keeps to the ground on its left; a way that comes back to a point has closed a ring there. A part that nothing goes on
    from is left out: only sides closer than the grid can come apart so.
    """

    def one(ax, ay, bx, by):
        begin = {}
        for i, p in enumerate(zip(ax, ay, strict=True)):
            begin.setdefault(p, []).append(i)

        def on(i):
            ways = begin.get((bx[i], by[i]), [])
            if len(ways) > 1:
                back = math.atan2(ay[i] - by[i], ax[i] - bx[i])
                ways = sorted(ways, key=lambda j: (back - math.atan2(by[j] - ay[j], bx[j] - ax[j])) % (2 * math.pi) or 2 * math.pi)
            return next((j for j in ways if not used[j]), None)

        used, rings = [False] * len(ax), []
        for start in range(len(ax)):
            way, at = [], {}  # parts so far, and where on the way a point is
            i = None if used[start] else start
            while i is not None:
                used[i] = True
                at[ax[i], ay[i]] = len(way)
                way.append(i)
                back = at.get((bx[i], by[i]))
                if back is not None:
                    ring, way = way[back:], way[:back]
                    for j in ring:
                        del at[ax[j], ay[j]]
                    rings.append([j for k, j in enumerate(ring) if (bx[j] - ax[j]) * (ay[j] - ay[ring[k - 1]]) != (by[j] - ay[j]) * (ax[j] - ax[ring[k - 1]])])
                    if not way:
                        break
                i = on(i)
        return [r for r in rings if len(r) > 2]

    return pd.Series([one(*(list(map(int, x)) for x in row)) for row in zip(ax, ay, bx, by, strict=True)])


def dissolved(sides: DataFrame) -> DataFrame:
    """of, ring, points, area, depth, hole, shell: the rings around the ground where the windings of the sides (of, p, q: points in metres) add up to more than zero.

    Coordinates are whole millimetres. Shells run counterclockwise and holes clockwise; hole and shell say which ring a hole lies in. Sides of one `of` meet by cells and
    strips; only its finished outline comes together, to be put in order. Sides without length count for nothing, no sides give no rows.
    """
    mm = lambda v: F.round(v * 1000).cast("long")
    p, q = F.col("p"), F.col("q")
    corner = sides.groupBy("of").agg(F.floor(F.min(F.least(p["x"], q["x"]))).alias("x0"), F.floor(F.min(F.least(p["y"], q["y"]))).alias("y0"))
    near = sides.join(corner, "of").select("of", *[mm(e[x] - F.col(f"{x}0")).alias(f"{n}{x}") for n, e in (("a", p), ("b", q)) for x in ("x", "y")], F.lit(1).alias("times"))
    parts = _parts(kept(_summed(near), "summed"))
    chained = _outline(parts).groupBy("of").agg(F.array_sort(F.collect_list(F.struct("ax", "ay", "bx", "by"))).alias("e"))
    ringed = chained.select("of", "e", F.posexplode(_rings(*[F.col(f"e.{x}") for x in ("ax", "ay", "bx", "by")])).alias("ring", "at")).join(corner, "of")
    spot = lambda i: geo.point(F.round(F.col("x0") + F.get("e", i)["ax"] / 1000, 3), F.round(F.col("y0") + F.get("e", i)["ay"] / 1000, 3))
    points = F.transform(F.concat("at", F.slice("at", 1, 1)), spot)
    found = kept(ringed.select(F.col("of").alias("id"), "ring", points.alias("points")), "rings")
    return ring_depths(found).withColumnRenamed("id", "of")


def shadow_outlines(buildings: DataFrame, suns: DataFrame) -> DataFrame:
    """bucket_start, source_id, ring, points, area, depth, hole, shell: each building's ground and shadow as one outline."""
    found = dissolved(swept_sides(buildings, suns))
    return found.select("of.bucket_start", "of.source_id", "ring", "points", "area", "depth", "hole", "shell")


def _apart(p: Column, a: Column, b: Column) -> Column:
    """How far p is from the line between a and b, squared."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    x, y = a["x"] + t * dx - p["x"], a["y"] + t * dy - p["y"]
    return x * x + y * y


def simplified(rings: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """id, ring, points of rings (id, ring, points: closed, without repeats in a row) with fewer points.

    Round by round points go whose triangle with their neighbours is the smallest around, if all that went before and lies between these neighbours stays within the
    tolerance of the line between them, and if no other point of the same id lies in the triangle: so lines that didn't cross don't cross afterwards. At
    least three points stay. A round looks at all points of a ring together and joins triangles with points by cells.
    """
    c = F.col
    point = F.struct("x", "y")
    vertices = rings.select("id", "ring", F.posexplode(F.slice("points", F.lit(1), F.size("points") - 1)).alias("pos", "p")).select("id", "ring", "pos", "p.x", "p.y", F.array().cast("array<struct<x:double,y:double>>").alias("gone"))
    vertices = kept(vertices, "vertices")
    size = 4.0
    around = W.partitionBy("id", "ring").orderBy("pos")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    beside = lambda v: (F.coalesce(F.lag(v).over(around), F.last(v).over(whole)), F.coalesce(F.lead(v).over(around), F.first(v).over(whole)))
    while True:
        before, after = beside(F.struct("pos", "x", "y", "gone"))
        seen = vertices.withColumns({"before": before, "after": after, "n": F.count(F.lit(1)).over(whole)})
        between = F.concat("gone", F.array(point), "after.gone")
        near = F.forall(between, lambda p: _apart(p, c("before"), c("after")) <= tolerance**2)
        twice = F.abs((c("before.x") - c("x")) * (c("after.y") - c("y")) - (c("before.y") - c("y")) * (c("after.x") - c("x")))
        could = kept(seen.filter((c("n") > 3) & near).select("id", "ring", "pos", "x", "y", "before", "after", twice.alias("twice")), "could")
        if could.isEmpty():
            break
        low = lambda v: F.least(c(v), c(f"before.{v}"), c(f"after.{v}"))
        high = lambda v: F.greatest(c(v), c(f"before.{v}"), c(f"after.{v}"))
        placed = _in_cells(could, low("x"), low("y"), high("x"), high("y"), size)
        others = vertices.select("id", F.floor(c("x") / size).alias("cx"), F.floor(c("y") / size).alias("cy"), c("ring").alias("oring"), c("pos").alias("opos"), F.struct("x", "y").alias("o"))
        turn = lambda a, b, p: F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))
        turns = [turn(*pair, c("o")) for pair in ((c("before"), point), (point, c("after")), (c("after"), c("before")))]
        within = ~((F.least(*turns) < 0) & (F.greatest(*turns) > 0)) & c("o.x").between(low("x"), high("x")) & c("o.y").between(low("y"), high("y"))
        own = (c("ring") == c("oring")) & c("opos").isin(c("pos"), c("before.pos"), c("after.pos"))
        blocked = placed.join(others, ["id", "cx", "cy"]).filter(within & ~own).select("id", "ring", "pos").distinct()
        free = could.join(blocked, ["id", "ring", "pos"], "left_anti").select("id", "ring", "pos", "twice")
        # of neighbours that could both go, the smaller triangle goes
        told = vertices.join(free, ["id", "ring", "pos"], "left")
        rank = F.when(c("twice").isNotNull(), F.struct("twice", "pos"))
        one, two = beside(F.struct(rank.alias("rank")))
        picked = told.withColumns({"one": one, "two": two})
        goes = rank.isNotNull() & F.coalesce(rank < c("one.rank"), F.lit(True)) & F.coalesce(rank < c("two.rank"), F.lit(True))
        marked = picked.withColumn("goes", goes)
        past, _ = beside(F.struct("goes", F.concat("gone", F.array(point)).alias("gone")))
        passed = marked.withColumn("past", past)
        left = passed.filter("not goes").select("id", "ring", "pos", "x", "y", F.when(c("past.goes"), F.concat("past.gone", "gone")).otherwise(c("gone")).alias("gone"))
        before_count, vertices = vertices, kept(left, "vertices")
        if before_count.count() == vertices.count():
            break
    back = vertices.groupBy("id", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda v: geo.point(v["x"], v["y"])).alias("points"))
    return back.select("id", "ring", F.concat("points", F.slice("points", 1, 1)).alias("points"))


def as_polygons(rings: DataFrame, key: str = "id") -> DataFrame:
    """key, polygons: of the key's rings (key, ring, hole, shell, points) each shell with its holes behind it."""
    one = F.struct(F.col("hole"), F.col("ring"), F.col("points"))
    shells = rings.groupBy(key, F.coalesce("shell", "ring").alias("shell")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["points"]).alias("polygon"))
    return shells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("shell", "polygon"))), lambda x: x["polygon"]).alias("polygons"))


def building_shadow_map(buildings: DataFrame, suns: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """bucket_start, source_id, name, height_m, height_source, quality_flags, polygons: each outline with fewer points, in degrees by offsets from the building's first point."""
    outlines = dissolved(swept_sides(buildings, suns)).withColumnRenamed("of", "id")
    outlines = kept(outlines, "outlines")
    fewer = simplified(outlines.select("id", "ring", "points"), tolerance).join(outlines.select("id", "ring", "hole", "shell"), ["id", "ring"])
    drawn = as_polygons(fewer).select("id.bucket_start", "id.source_id", "polygons")
    first_m, first = F.col("footprint_m")[0][0].alias("m"), F.col("footprint_wgs84")[0][0].alias("w")
    known = buildings.select("source_id", "name", "height_m", "height_source", "quality_flags", first_m, first)
    degrees = F.transform("polygons", lambda rings: F.transform(rings, lambda r: geo.metric_to_wgs84(r, F.col("m"), F.col("w.x"), F.col("w.y"))))
    return drawn.join(known, "source_id").select("bucket_start", "source_id", "name", "height_m", "height_source", "quality_flags", degrees.alias("polygons"))
