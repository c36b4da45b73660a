"""Queries on shadows and on the shade of edges, at a stated list of instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.functions.solar import shadow_length as reach
from penumbra.functions.solar import with_solar
from penumbra.operators import outlines, shade, shade_table, shadows
from penumbra.operators.graph import kept, shared_base
from penumbra.plans.ingest import BUILDINGS_CLEAN, POINTS, TREES_CLEAN, buildings, trees, utm_sql
from penumbra.plans.solar import solar_sql
from penumbra.plans.tables import BUILDINGS, EDGES, edges, nodes, raw_buildings
from penumbra.registry import query

#: The instants asked about: morning, noon, evening and night of a day in June.
INSTANTS = ("2026-06-21 12:00:00", "2026-06-21 18:00:00", "2026-06-22 00:00:00", "2026-06-22 06:00:00")
_AT = ", ".join(f"(TIMESTAMP '{at}')" for at in INSTANTS)
SUNS = f"asked(bucket_start) AS (VALUES {_AT}), {solar_sql('asked', 'bucket_start', 'bucket_start')}, lit AS (SELECT * FROM solar WHERE daylight)"
REACH = "least({height} / tan(radians(apparent_altitude)), 100)"
CAPSULES = f"""{TREES_CLEAN}, {SUNS}, cap1 AS (
  SELECT bucket_start, source_id, e, n, lon, lat, canopy_radius_m AS r, {REACH.format(height="height_m")} AS len, height_m / tan(radians(apparent_altitude)) > 100 AS length_capped, radians(90 - shadow_azimuth) AS d FROM tree, lit WHERE shade_ready
), cap2 AS (SELECT *, unnest(range(0, 19)) AS i FROM cap1
), capsule AS (
  SELECT bucket_start, source_id, i, round(e + CASE WHEN i BETWEEN 9 AND 17 THEN len * cos(d) + r * cos(d - pi() / 2 + (i - 9) * (pi() / 8)) ELSE r * cos(d + pi() / 2 + (i % 18) * (pi() / 8)) END, 3) AS x,
    round(n + CASE WHEN i BETWEEN 9 AND 17 THEN len * sin(d) + r * sin(d - pi() / 2 + (i - 9) * (pi() / 8)) ELSE r * sin(d + pi() / 2 + (i % 18) * (pi() / 8)) END, 3) AS y FROM cap2)"""
#: The same shadows as drawn on a map: eight segments, in degrees by offsets from the tree.
DRAWN = f"""{CAPSULES}, draw1 AS (
  SELECT *, round(len, 3) AS l, 111132.92e0 - 559.82e0 * cos(2 * radians(lat)) + 1.175e0 * cos(4 * radians(lat)) - 0.0023e0 * cos(6 * radians(lat)) AS per_lat,
    111412.84e0 * cos(radians(lat)) - 93.5e0 * cos(3 * radians(lat)) + 0.118e0 * cos(5 * radians(lat)) AS per_lon FROM cap1
), draw2 AS (SELECT *, unnest(range(0, 11)) AS i FROM draw1
), drawn AS (
  SELECT *, round(e + CASE WHEN i BETWEEN 5 AND 9 THEN l * cos(d) + r * cos(d - pi() / 2 + (i - 5) * (pi() / 4)) ELSE r * cos(d + pi() / 2 + (i % 10) * (pi() / 4)) END, 3) AS x,
    round(n + CASE WHEN i BETWEEN 5 AND 9 THEN l * sin(d) + r * sin(d - pi() / 2 + (i - 5) * (pi() / 4)) ELSE r * sin(d + pi() / 2 + (i % 10) * (pi() / 4)) END, 3) AS y FROM draw2)"""
FOOTPRINTS = f"""{BUILDINGS_CLEAN}, {POINTS[POINTS.index("ring AS") :]}, fp AS (
  SELECT u.objectid AS source_id, ring, pos, round(e, 3) AS x, round(n, 3) AS y, estimated_height_m AS height_m FROM utm u JOIN building b ON b.source_id = u.objectid WHERE shade_ready
), fside AS (SELECT * FROM (SELECT source_id, ring, pos, height_m, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fp WINDOW w AS (PARTITION BY source_id, ring ORDER BY pos)) WHERE x2 IS NOT NULL)"""
#: The common table expressions of trees and of footprints both end in `utm`: the trees' are renamed.
_TREE_PART = CAPSULES.replace("utm AS", "tutm AS").replace("FROM utm", "FROM tutm").replace("u1 ", "tu1 ").replace("u2 ", "tu2 ").replace("u3 ", "tu3 ").replace("FROM u1)", "FROM tu1)").replace("FROM u2)", "FROM tu2)").replace("FROM u3)", "FROM tu3)")
PIECES = f"""{_TREE_PART}, {FOOTPRINTS}, thrown AS (
  SELECT bucket_start, f.*, {REACH.format(height="height_m")} * sin(radians(shadow_azimuth)) AS dx, {REACH.format(height="height_m")} * cos(radians(shadow_azimuth)) AS dy, row_number() OVER (PARTITION BY bucket_start, source_id ORDER BY ring, pos) AS nth FROM fside f, lit
), side AS (
  SELECT bucket_start, 'tree' AS kind, source_id, 0 AS piece, x AS x1, y AS y1, x2, y2 FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM capsule WINDOW w AS (PARTITION BY bucket_start, source_id ORDER BY i)) WHERE x2 IS NOT NULL
  UNION ALL SELECT bucket_start, 'building', source_id, -2, x1, y1, x2, y2 FROM thrown
  UNION ALL SELECT bucket_start, 'building', source_id, -1, x1 + dx, y1 + dy, x2 + dx, y2 + dy FROM thrown
  UNION ALL SELECT bucket_start, 'building', source_id, nth, unnest([x1, x2, x2 + dx, x1 + dx]), unnest([y1, y2, y2 + dy, y1 + dy]), unnest([x2, x2 + dx, x1 + dx, x1]), unnest([y2, y2 + dy, y1 + dy, y1]) FROM thrown WHERE abs((x2 - x1) * dy - (y2 - y1) * dx) > 1e-9
), box AS (SELECT bucket_start, kind, source_id, piece, min(x1) AS px0, max(x1) AS px1, min(y1) AS py0, max(y1) AS py1 FROM side GROUP BY ALL)"""
LINES = f"""{EDGES}, {utm_sql("node", "lon", "lat", "node_id").replace("u1 ", "nu1 ").replace("u2 ", "nu2 ").replace("u3 ", "nu3 ").replace("FROM u1)", "FROM nu1)").replace("FROM u2)", "FROM nu2)").replace("FROM u3)", "FROM nu3)").replace("utm AS", "nutm AS")},
line AS (SELECT lo, hi, distance_m, a.e AS lx0, a.n AS ly0, b.e AS lx1, b.n AS ly1 FROM edge JOIN nutm a ON a.node_id = lo JOIN nutm b ON b.node_id = hi)"""
SPANS = f"""{PIECES}, {LINES}, near AS (
  SELECT * FROM line JOIN box ON least(lx0, lx1) <= px1 AND px0 <= greatest(lx0, lx1) AND least(ly0, ly1) <= py1 AND py0 <= greatest(ly0, ly1)
), off AS (
  SELECT bucket_start, lo, hi, kind, source_id, piece, (lx1 - lx0) * (y1 - ly0) - (ly1 - ly0) * (x1 - lx0) AS oa, (lx1 - lx0) * (y2 - ly0) - (ly1 - ly0) * (x2 - lx0) AS ob,
    ((x1 - lx0) * (lx1 - lx0) + (y1 - ly0) * (ly1 - ly0)) / ((lx1 - lx0) ** 2 + (ly1 - ly0) ** 2) AS ta, ((x2 - lx0) * (lx1 - lx0) + (y2 - ly0) * (ly1 - ly0)) / ((lx1 - lx0) ** 2 + (ly1 - ly0) ** 2) AS tb
  FROM near JOIN side USING (bucket_start, kind, source_id, piece)
), hit AS (SELECT bucket_start, lo, hi, kind, source_id, piece, ta + (tb - ta) * oa / (oa - ob) AS t FROM off WHERE (oa < 0) <> (ob < 0)
), paired AS (SELECT *, row_number() OVER w AS rn, lead(t) OVER w AS t2 FROM hit WINDOW w AS (PARTITION BY bucket_start, lo, hi, kind, source_id, piece ORDER BY t)
), span AS (SELECT bucket_start, lo, hi, kind, source_id, piece, greatest(t, 0) AS t0, least(t2, 1) AS t1 FROM paired WHERE rn % 2 = 1 AND least(t2, 1) > greatest(t, 0))"""
SHADE = f"""{SPANS}, part AS (SELECT bucket_start, lo, hi, t0, t1, max(t1) OVER (PARTITION BY bucket_start, lo, hi ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM span
), cover AS (SELECT bucket_start, lo, hi, least(1, sum(greatest(0, t1 - greatest(t0, coalesce(before, 0))))) AS fraction FROM part GROUP BY 1, 2, 3
), shade AS (SELECT s.bucket_start, s.daylight, lo, hi, distance_m, coalesce(fraction, 0) AS fraction FROM edge CROSS JOIN solar s LEFT JOIN cover USING (bucket_start, lo, hi))"""


def suns(spark: SparkSession, instants: tuple[str, ...] = INSTANTS) -> DataFrame:
    """The sun at the instants: as many rows as the list has, computed once rather than in every expression that uses them."""
    at = spark.createDataFrame([(a,) for a in instants], "at string").select(F.col("at").cast("timestamp_ntz").alias("bucket_start"))
    found = with_solar(at, "bucket_start")
    return spark.createDataFrame(found.collect(), found.schema)


def ready_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings that throw a shadow; footprints are projected once and checked once, then written, since all that follows looks at each of them many times."""
    normal = kept(buildings(spark, sf_dir).withColumn("pos", F.col("source_id")), "buildings")
    return kept(shadows.eligible_buildings(normal), "eligible")


@query("shadow_length", f"WITH {TREES_CLEAN}, {SUNS} SELECT bucket_start, source_id, round({REACH.format(height='height_m')}, 3) AS length_m FROM tree, lit WHERE height_m IS NOT NULL")
def shadow_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = suns(spark).filter("daylight").select("bucket_start", "apparent_altitude")
    tall = trees(spark, sf_dir).filter("height_m is not null").select("source_id", "height_m")
    return tall.crossJoin(F.broadcast(lit)).select("bucket_start", "source_id", F.round(reach(F.col("height_m"), F.col("apparent_altitude")), 3).alias("length_m"))


@query("tree_shadow", f"WITH {CAPSULES} SELECT bucket_start, source_id, round(len, 3) AS length_m, length_capped FROM cap1")
def tree_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadows.tree_shadows(trees(spark, sf_dir), suns(spark)).select("bucket_start", "source_id", "length_m", "length_capped")


@query("tree_shadow_polygon", f"WITH {CAPSULES} SELECT bucket_start, source_id, CAST(i AS INTEGER) AS pos, x, y FROM capsule")
def tree_shadow_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per point of each shadow's outline, which always has some; a plain explode would ask first, and compute it once more for that."""
    found = shadows.tree_shadows(trees(spark, sf_dir), suns(spark))
    return found.select("bucket_start", "source_id", F.posexplode_outer("polygon").alias("pos", "p")).select("bucket_start", "source_id", "pos", "p.x", "p.y")


@query("metric_to_wgs84", f"WITH {DRAWN} SELECT bucket_start, source_id, CAST(i AS INTEGER) AS pos, round(lon + (x - e) / per_lon, 7) AS lon, round(lat + (y - n) / per_lat, 7) AS lat FROM drawn")
def metric_to_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per point of each tree shadow as drawn on the map."""
    found = shadows.tree_shadow_map(trees(spark, sf_dir), suns(spark))
    return found.select("bucket_start", "source_id", F.posexplode_outer("ring").alias("pos", "p")).select("bucket_start", "source_id", "pos", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


@query(
    "tree_bucket_header",
    f"""WITH {CAPSULES}, k AS (SELECT (SELECT count(*) FROM tree WHERE shade_ready) AS eligible, (SELECT count(*) FROM tree WHERE NOT shade_ready) AS excluded)
SELECT s.bucket_start, s.daylight, count(c.source_id) AS shadow_count, coalesce(max(round(c.len, 3)), 0) AS max_length_m, k.eligible, k.excluded FROM solar s LEFT JOIN cap1 c USING (bucket_start), k GROUP BY ALL""",
)
def tree_bucket_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees(spark, sf_dir)
    kept = shadows.eligible_trees(rows).agg(F.count(F.lit(1)).alias("eligible"))
    k = rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(kept).select("eligible", (F.col("total") - F.col("eligible")).alias("excluded"))
    sums = shadows.tree_shadows(rows, suns(spark)).groupBy("bucket_start").agg(F.count(F.lit(1)).alias("shadow_count"), F.max("length_m").alias("max_length_m"))
    head = suns(spark).select("bucket_start", "daylight").join(sums, "bucket_start", "left")
    return head.crossJoin(F.broadcast(k)).select("bucket_start", "daylight", F.coalesce("shadow_count", F.lit(0)).alias("shadow_count"), F.coalesce("max_length_m", F.lit(0.0)).alias("max_length_m"), "eligible", "excluded")


@query("building_shadow", f"WITH {PIECES} SELECT bucket_start, source_id, count(DISTINCT piece) AS pieces, count(*) AS sides, round(max(px1) - min(px0), 1) AS width_m, round(max(py1) - min(py0), 1) AS depth_m FROM side JOIN box USING (bucket_start, kind, source_id, piece) WHERE kind = 'building' GROUP BY 1, 2")
def building_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each building's shadow by the pieces that make it up, and its extent."""
    found = shadows.building_pieces(ready_buildings(spark, sf_dir), suns(spark))
    xs, ys = F.transform("sides", lambda s: s["p"]["x"]), F.transform("sides", lambda s: s["p"]["y"])
    boxed = found.select("bucket_start", "source_id", F.size("sides").alias("n"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    return boxed.groupBy("bucket_start", "source_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("sides"), F.round(F.max("x1") - F.min("x0"), 1).alias("width_m"), F.round(F.max("y1") - F.min("y0"), 1).alias("depth_m"))


@query(
    "building_bucket_header",
    f"""WITH {PIECES}, len AS (SELECT bucket_start, source_id, {REACH.format(height="estimated_height_m")} AS len FROM building, lit WHERE shade_ready), k AS (SELECT count(*) FILTER (shade_ready) AS eligible, count(*) FILTER (NOT shade_ready) AS excluded FROM building)
SELECT s.bucket_start, s.daylight, count(l.source_id) AS shadow_count, coalesce(max(round(l.len, 3)), 0) AS max_length_m, k.eligible, k.excluded FROM solar s LEFT JOIN len l USING (bucket_start), k GROUP BY ALL""",
)
def building_bucket_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = ready_buildings(spark, sf_dir)
    total = buildings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    k = total.crossJoin(ready.agg(F.count(F.lit(1)).alias("eligible"))).select("eligible", (F.col("total") - F.col("eligible")).alias("excluded"))
    sums = shadows.by_instant(ready.select("source_id", "height_m"), suns(spark)).groupBy("bucket_start").agg(F.count(F.lit(1)).alias("shadow_count"), F.max(F.round("reach", 3)).alias("max_length_m"))
    head = suns(spark).select("bucket_start", "daylight").join(sums, "bucket_start", "left")
    return head.crossJoin(F.broadcast(k)).select("bucket_start", "daylight", F.coalesce("shadow_count", F.lit(0)).alias("shadow_count"), F.coalesce("max_length_m", F.lit(0.0)).alias("max_length_m"), "eligible", "excluded")


#: Rings of many kinds in the box of a supplier, each as corners in shares of its width and height: a bow tie, a plain bend, an open one, one with repeated points, one of three
#: points, one with an unknown point, one that runs out and back, and one whose corner touches a side.
RING_KINDS = (
    ((0, 0), (1, 1), (1, 0), (0, 1), (0, 0)),
    ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)),
    ((0, 0), (1, 0), (1, 1), (0, 1)),
    ((0, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 1), (0, 0)),
    ((0, 0), (1, 0), (0, 0)),
    ((0, 0), (1, 0), (None, 1), (0, 1), (0, 0)),
    ((0, 0), (1, 0), (1, 1), (1, 2), (1, 1), (0, 1), (0, 0)),
    ((0, 0), (1, 0), (1, 1), (0.5, 0), (0, 1), (0, 0)),
)
#: A house, its yard, a house in the yard with a yard of its own, and a house beside it.
NESTED = (((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), *(tuple((a + (1 - 2 * a) * x, a + (1 - 2 * a) * y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))) for a in (0.125, 0.25, 0.375)), ((1.25, 0), (1.5, 0), (1.5, 1), (1.25, 1), (1.25, 0)))


def _corners(ring) -> list[tuple[str, str]]:
    """A ring as SQL for either engine: x and y of each corner."""
    spot = lambda v, low, size: "CAST(NULL AS DOUBLE)" if v is None else f"{low} + {size} * {float(v)}e0"
    return [(spot(x, "w0", "w"), spot(y, "s0", "h")) for x, y in ring]


def _duck(ring) -> str:
    return "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in _corners(ring)) + "]"


def _drawn(ring):
    return F.array(*[geo.point(F.expr(x), F.expr(y)) for x, y in _corners(ring)])


_BOXES = BUILDINGS.split(", raw_building AS")[0]
_INSIDE = "count(*) FILTER ((s.y > q.y) <> (s.y2 > q.y) AND q.x < (s.x2 - s.x) * (q.y - s.y) / (s.y2 - s.y) + s.x) % 2 = 1"


@query(
    "ring_topology",
    f"""WITH {_BOXES}, r AS (SELECT objectid, unnest([{", ".join(map(_duck, NESTED))}]) AS points, unnest(range(0, {len(NESTED)})) AS ring FROM raw_box),
v AS (SELECT objectid, ring, generate_subscripts(points, 1) AS pos, unnest(points) AS p FROM r), s AS (SELECT objectid, ring, pos, p.x AS x, p.y AS y, lead(p.x) OVER w AS x2, lead(p.y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY objectid, ring ORDER BY pos)),
area AS (SELECT objectid, ring, abs(sum((x - 0e0) * y2 - x2 * y)) / 2 AS area FROM s GROUP BY ALL), held AS (SELECT q.objectid, q.ring, s.ring AS outer_ring FROM s q JOIN s ON s.objectid = q.objectid AND s.ring <> q.ring WHERE q.pos = 1 GROUP BY ALL HAVING {_INSIDE}),
depth AS (SELECT a.objectid, a.ring, count(h.outer_ring) AS depth FROM area a LEFT JOIN held h ON h.objectid = a.objectid AND h.ring = a.ring GROUP BY ALL)
SELECT d.objectid, CAST(d.ring AS INTEGER) AS ring, d.depth, d.depth % 2 = 1 AS hole,
  CASE WHEN d.depth % 2 = 1 THEN CAST((SELECT arg_max(h.outer_ring, o.depth) FROM held h JOIN depth o ON o.objectid = h.objectid AND o.ring = h.outer_ring WHERE h.objectid = d.objectid AND h.ring = d.ring AND o.depth % 2 = 0) AS INTEGER) END AS shell FROM depth d""",
)
def ring_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and shell of houses, yards, and houses in yards."""
    rings = raw_buildings(spark, sf_dir).select(F.col("objectid").alias("id"), F.posexplode(F.array(*map(_drawn, NESTED))).alias("ring", "points"))
    return shadows.ring_depths(rings).select(F.col("id").alias("objectid"), "ring", "depth", "hole", "shell")


@query(
    "ring_validate",
    f"""WITH {_BOXES}, r AS (SELECT objectid, CASE objectid % 8 {" ".join(f"WHEN {i} THEN {_duck(k)}" for i, k in enumerate(RING_KINDS))} END AS points FROM raw_box),
v AS (SELECT objectid, len(points) AS many, generate_subscripts(points, 1) AS pos, unnest(points) AS p FROM r), f AS (SELECT objectid, many, pos, p.x AS x, p.y AS y, lag(p.x) OVER w AS bx, lag(p.y) OVER w AS b_y FROM v WINDOW w AS (PARTITION BY objectid ORDER BY pos)),
k AS (SELECT objectid, many, x, y, row_number() OVER (PARTITION BY objectid ORDER BY pos) AS i FROM f WHERE pos = 1 OR x IS DISTINCT FROM bx OR y IS DISTINCT FROM b_y),
s AS (SELECT objectid, i, count(*) OVER (PARTITION BY objectid) - 1 AS n, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM k WINDOW w AS (PARTITION BY objectid ORDER BY i)), side AS (SELECT * FROM s WHERE i <= n),
pair AS (SELECT a.objectid, a.i = 1 AND b.i = a.n AS closing, b.i = a.i + 1 AS following, a.ax, a.ay, a.bx, a.b_y, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.b_y AS dy FROM side a JOIN side b ON b.objectid = a.objectid AND b.i > a.i),
t AS (SELECT *, sign((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) AS t1, sign((bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax)) AS t2, sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) AS t3, sign((dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx)) AS t4, (bx - ax) * (dx - cx) + (b_y - ay) * (dy - cy) AS ahead FROM pair),
bad AS (SELECT DISTINCT objectid FROM t WHERE CASE WHEN following THEN t2 = 0 AND ahead < 0 WHEN closing THEN t4 = 0 AND ahead < 0 ELSE (t1 * t2 < 0 AND t3 * t4 < 0) OR (t1 = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, b_y) AND greatest(ay, b_y)) OR (t2 = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND dy BETWEEN least(ay, b_y) AND greatest(ay, b_y))
  OR (t3 = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy)) OR (t4 = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND b_y BETWEEN least(cy, dy) AND greatest(cy, dy)) END),
whole AS (SELECT objectid, many >= 4 AND count(*) >= 4 AND bool_and(x IS NOT NULL AND y IS NOT NULL) AND count(DISTINCT (x, y)) >= 3 AND arg_min(x, i) = arg_max(x, i) AND arg_min(y, i) = arg_max(y, i) AS fine FROM k GROUP BY objectid, many),
area AS (SELECT objectid, abs(sum(ax * b_y - bx * ay)) > 1e-15 AS spread FROM side GROUP BY objectid)
SELECT objectid, coalesce(fine AND spread, false) AND objectid NOT IN (SELECT objectid FROM bad) AS valid FROM whole LEFT JOIN area USING (objectid)""",
)
def ring_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of rings of many kinds are footprints."""
    kind = F.col("objectid") % 8
    ring = F.lit(None).cast("array<struct<x:double,y:double>>")
    for i, corners in enumerate(RING_KINDS):
        ring = F.when(kind == i, _drawn(corners)).otherwise(ring)
    return raw_buildings(spark, sf_dir).select("objectid", shadows.valid_ring(ring).alias("valid"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shade.edge_lines(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("edge_lines", f"WITH {LINES} SELECT lo, hi, round(lx0, 3) AS x0, round(ly0, 3) AS y0, round(lx1, 3) AS x1, round(ly1, 3) AS y1 FROM line")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("lo", "hi", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def all_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shade.pieces(trees(spark, sf_dir), ready_buildings(spark, sf_dir), suns(spark))


@query("edge_shadow_join", f"WITH {SPANS} SELECT bucket_start, lo, hi, kind, source_id, CAST(count(DISTINCT piece) AS BIGINT) AS pieces, round(sum(t1 - t0), 3) AS crossed FROM span GROUP BY ALL")
def edge_shadow_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shadows fall on which edges, in how many pieces, and how much they cross of them in all."""
    found = shade.edge_shadows(lines(spark, sf_dir), all_pieces(spark, sf_dir))
    return found.withColumn("crossed", F.round("crossed", 3))


def shade_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shade.edge_shade(lines(spark, sf_dir), all_pieces(spark, sf_dir), suns(spark))


def shade_at(spark: SparkSession, sf_dir: str, *instants: str) -> DataFrame:
    """The shade of all edges at the instants alone, from the table by bucket, which computes what it doesn't have yet."""

    def compute(new: DataFrame) -> DataFrame:
        return shade.edge_shade(lines(spark, sf_dir), shade.pieces(trees(spark, sf_dir), ready_buildings(spark, sf_dir), new), new)

    version = shade_table.version_of(spark, [f"{sf_dir}/{t}.parquet" for t in ("part", "supplier", "customer")])
    return shade_table.edge_shade_by_bucket(suns(spark, instants), f"{shared_base(spark)}/edge-shade-{version}", compute)


@query("edge_shade", f"WITH {SHADE} SELECT bucket_start, daylight, lo, hi, round(fraction, 4) AS fraction FROM shade")
def edge_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shade_of_edges(spark, sf_dir).select("bucket_start", "daylight", "lo", "hi", F.round("fraction", 4).alias("fraction"))


@query("edge_cost", f"WITH {SHADE} SELECT bucket_start, lo, hi, round(distance_m * (1 - 0.7e0 * fraction), 2) AS cost FROM shade")
def edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shade.edge_costs(shade_of_edges(spark, sf_dir)).select("bucket_start", "lo", "hi", F.round("cost", 2).alias("cost"))


_SPAN = "SELECT l_orderkey AS line, (l_partkey % 90) / 100e0 AS t0, (l_partkey % 90) / 100e0 + l_quantity / 500e0 AS t1 FROM lineitem"


@query(
    "line_fraction",
    f"""WITH s AS ({_SPAN}), p AS (SELECT *, max(t1) OVER (PARTITION BY line ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT line, round(least(1, sum(greatest(0, t1 - greatest(t0, coalesce(before, 0))))), 6) AS fraction FROM p GROUP BY line""",
)
def line_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What overlapping spans cover of each line, each part counted once."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spans = items.selectExpr("l_orderkey AS line", "(l_partkey % 90) / 100e0 AS t0", "(l_partkey % 90) / 100e0 + l_quantity / 500e0 AS t1")
    return shade.covered(spans, ["line"]).select("line", F.round("fraction", 6).alias("fraction"))


@query("tree_geojson")
def tree_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature for each instant and tree: a map asks for those in what it shows (cx, cy: cells of 0.002 degrees), and no row holds more than a shadow."""
    found = shadows.tree_shadow_map(trees(spark, sf_dir), suns(spark))
    x, y = F.floor(F.get("ring", F.lit(0))["x"] / 0.002).alias("cx"), F.floor(F.get("ring", F.lit(0))["y"] / 0.002).alias("cy")
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))
    properties = F.create_map(F.lit("source_id"), F.col("source_id").cast("string"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))
    return found.select("bucket_start", "source_id", x, y, feature.alias("feature"))


@query(
    "swept_footprint",
    f"""WITH {PIECES}, ruled AS (SELECT bucket_start, source_id, piece, unnest(range(CAST(floor(py0 / 0.25) AS BIGINT), CAST(floor(py1 / 0.25) AS BIGINT) + 1)) AS line FROM box WHERE kind = 'building'),
hit AS (SELECT bucket_start, source_id, piece, line, x1 + (x2 - x1) * ((line + 0.5e0) / 4 - y1) / (y2 - y1) AS x FROM ruled JOIN side USING (bucket_start, source_id, piece) WHERE kind = 'building' AND (y1 < (line + 0.5e0) / 4) <> (y2 < (line + 0.5e0) / 4)),
paired AS (SELECT *, row_number() OVER w AS rn, lead(x) OVER w AS x2 FROM hit WINDOW w AS (PARTITION BY bucket_start, source_id, line, piece ORDER BY x)),
part AS (SELECT *, max(x2) OVER (PARTITION BY bucket_start, source_id, line ORDER BY x, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM paired WHERE rn % 2 = 1 AND x2 > x)
SELECT bucket_start, source_id, round(sum(greatest(0, x2 - greatest(x, coalesce(before, x)))) / 4, 1) AS area_m2 FROM part GROUP BY 1, 2""",
)
def swept_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground that each building and its shadow cover, measured along lines 25 cm apart."""
    found = shadows.swept_area(shadows.building_pieces(ready_buildings(spark, sf_dir), suns(spark)))
    return found.select("bucket_start", "source_id", F.round("area_m2", 1).alias("area_m2"))


def building_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.building_shadow_map(ready_buildings(spark, sf_dir), suns(spark))


@query("shadow_outline")
def shadow_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per ring around the ground that a building and its shadow cover: what swept_footprint measures, as one outline."""
    found = outlines.shadow_outlines(ready_buildings(spark, sf_dir), suns(spark))
    return found.select("bucket_start", "source_id", "ring", "hole", "shell", F.size("points").alias("points"), F.round("area", 3).alias("area_m2"))


@query(
    "building_map_header",
    # a swept connected footprint is connected, and every footprint here is, so there is one polygon for each shadow
    f"""WITH {PIECES}, k AS (SELECT count(*) FILTER (shade_ready) AS eligible, count(*) FILTER (NOT shade_ready) AS excluded FROM building)
SELECT bucket_start, 15 AS bucket_minutes, daylight, round(shadow_azimuth, 4) AS shadow_azimuth, eligible, excluded,
       CASE WHEN daylight THEN eligible ELSE 0 END AS shadow_count, CASE WHEN daylight THEN eligible ELSE 0 END AS polygon_count FROM solar, k""",
)
def building_map_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes before the features of a map of building shadows: the bucket, the sun, and how many buildings, shadows and polygons there are."""
    ready = ready_buildings(spark, sf_dir)
    total = buildings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    k = total.crossJoin(ready.agg(F.count(F.lit(1)).alias("eligible"))).select("eligible", (F.col("total") - F.col("eligible")).alias("excluded"))
    shells = outlines.shadow_outlines(ready, suns(spark)).filter("not hole").groupBy("bucket_start").agg(F.countDistinct("source_id").alias("shadow_count"), F.count(F.lit(1)).alias("polygon_count"))
    head = suns(spark).select("bucket_start", F.lit(15).alias("bucket_minutes"), "daylight", F.round("shadow_azimuth", 4).alias("shadow_azimuth")).join(shells, "bucket_start", "left")
    return head.crossJoin(F.broadcast(k)).withColumns({x: F.coalesce(x, F.lit(0)) for x in ("shadow_count", "polygon_count")})


@query(
    "tree_map_header",
    f"WITH {TREES_CLEAN}, {SUNS}, k AS (SELECT count(*) FILTER (shade_ready) AS n FROM tree) SELECT bucket_start, 15 AS bucket_minutes, daylight, round(shadow_azimuth, 4) AS shadow_azimuth, CASE WHEN daylight THEN n ELSE 0 END AS shadow_count FROM solar, k",
)
def tree_map_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same before the drawing of tree shadows."""
    found = shadows.by_instant(shadows.eligible_trees(trees(spark, sf_dir)).select("height_m"), suns(spark)).groupBy("bucket_start").agg(F.count(F.lit(1)).alias("shadow_count"))
    head = suns(spark).select("bucket_start", F.lit(15).alias("bucket_minutes"), "daylight", F.round("shadow_azimuth", 4).alias("shadow_azimuth")).join(found, "bucket_start", "left")
    return head.withColumn("shadow_count", F.coalesce("shadow_count", F.lit(0)))


@query("building_map")
def building_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per point of each building shadow as drawn on the map: its outline, simplified to 25 cm; ring 0 of a polygon is its shell."""
    polygons = building_drawings(spark, sf_dir).select("bucket_start", "source_id", F.posexplode("polygons").alias("polygon", "rings"))
    rings = polygons.select("bucket_start", "source_id", "polygon", F.posexplode("rings").alias("ring", "points"))
    return rings.select("bucket_start", "source_id", "polygon", "ring", F.posexplode("points").alias("pos", "p")).select("bucket_start", "source_id", "polygon", "ring", "pos", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


@query("building_geojson")
def building_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature for each building and instant, with properties as strings."""
    drawn = building_drawings(spark, sf_dir)
    coordinates = F.transform("polygons", lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    named = {"building_id": F.col("source_id").cast("string"), "name": F.coalesce("name", F.lit("")), "estimated_height_m": F.col("height_m").cast("string"), "height_source": F.col("height_source"), "quality_flags": F.array_join("quality_flags", ",")}
    properties = F.create_map(*[x for name, value in named.items() for x in (F.lit(name), value)])
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    return drawn.select("bucket_start", "source_id", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))
