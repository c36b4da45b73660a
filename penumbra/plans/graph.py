"""Queries on the walkway graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import graph
from penumbra.plans.campus import SNAPS, snaps
from penumbra.plans.tables import DISTANCE, EDGES, NODES, edges, nodes
from penumbra.registry import query

_HIGHWAY = "CASE way_id % 6 WHEN 0 THEN 'footway' WHEN 1 THEN 'path' WHEN 2 THEN 'cycleway' WHEN 3 THEN 'residential' WHEN 4 THEN 'steps' ELSE 'pedestrian' END"
_FOOT = "CASE way_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'designated' END"
_ACCESS = "CASE WHEN way_id % 11 = 7 THEN 'private' END"
WAYS = f"""{NODES}, line AS (SELECT r AS way_id, list(node_id ORDER BY c) AS refs FROM node GROUP BY r UNION ALL SELECT 100000 + c, list(node_id ORDER BY r) FROM node GROUP BY c),
way AS (SELECT way_id, refs, {_HIGHWAY} AS highway, {_FOOT} AS foot, {_ACCESS} AS access FROM line),
walk AS (SELECT * FROM way WHERE coalesce(foot, '') NOT IN ('no', 'private') AND coalesce(access, '') NOT IN ('no', 'private') AND (highway IN ('footway', 'path', 'pedestrian', 'steps') OR highway = 'cycleway' AND foot IN ('yes', 'designated', 'permissive'))),
seg AS (SELECT way_id, highway, generate_subscripts(refs, 1) AS s, unnest(refs) AS a, unnest(refs[2:] || [NULL]) AS b FROM walk),
way_edge AS (SELECT least(x.node_id, y.node_id) AS lo, greatest(x.node_id, y.node_id) AS hi, arg_min(highway, (d, way_id, s)) AS highway, round(min(d), 2) AS distance_m
  FROM (SELECT seg.*, x, y, {DISTANCE.format(a="x", b="y")} AS d FROM seg JOIN node x ON x.node_id = a JOIN node y ON y.node_id = b WHERE a <> b) GROUP BY 1, 2)"""


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of the grid as ways with tags, as a map extract has them."""
    n = nodes(spark, sf_dir)
    line = lambda way, by: n.groupBy(way.alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "node_id"))), lambda s: s["node_id"]).alias("refs"))
    lines = line(F.col("r"), "c").unionAll(line(F.col("c") + 100_000, "r"))
    tags = F.map_filter(F.create_map(F.lit("highway"), F.expr(_HIGHWAY), F.lit("foot"), F.expr(_FOOT), F.lit("access"), F.expr(_ACCESS)), lambda _, v: v.isNotNull())
    return lines.select("way_id", F.col("way_id").alias("pos"), "refs", tags.alias("tags"))


def way_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_from_ways(ways(spark, sf_dir), nodes(spark, sf_dir))


@query("osm_walkable", f"WITH {WAYS} SELECT way_id, highway, len(refs) AS n_refs FROM walk")
def osm_walkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ways(spark, sf_dir).filter(graph.walkable(F.col("tags")))
    return found.select("way_id", F.element_at("tags", F.lit("highway")).alias("highway"), F.size("refs").cast("long").alias("n_refs"))


@query("graph_edges", f"WITH {WAYS} SELECT lo, hi, distance_m, highway FROM way_edge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return way_edges(spark, sf_dir).orderBy("lo", "hi")


@query("graph_nodes", f"WITH {WAYS} SELECT node_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM node WHERE node_id IN (SELECT lo FROM way_edge UNION SELECT hi FROM way_edge)")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = way_edges(spark, sf_dir)
    used = e.select(F.explode(F.array("lo", "hi")).alias("node_id")).distinct()
    return nodes(spark, sf_dir).join(used, "node_id").select("node_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("graph_summary", f"WITH {WAYS} SELECT (SELECT count(*) FROM walk) AS way_count, (SELECT count(*) FROM way_edge) AS edge_count")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_ways = ways(spark, sf_dir).filter(graph.walkable(F.col("tags"))).agg(F.count(F.lit(1)).alias("way_count"))
    return n_ways.join(way_edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edge_count")))


@query("graph_adjacency", f"WITH {EDGES} SELECT lo AS src, hi AS dst, distance_m FROM edge UNION ALL SELECT hi, lo, distance_m FROM edge")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.both_ways(edges(spark, sf_dir).select("lo", "hi", "distance_m"))


COMPONENTS = f"""{EDGES}, arc AS (SELECT lo AS a, hi AS b FROM edge UNION ALL SELECT hi, lo FROM edge),
reach(node_id, component) USING KEY (node_id) AS (SELECT a, a FROM arc UNION (SELECT arc.b, min(reach.component) FROM reach JOIN arc ON arc.a = reach.node_id JOIN recurring.reach r ON r.node_id = arc.b WHERE reach.component < r.component GROUP BY arc.b))"""


@query("connected_components", f"WITH RECURSIVE {COMPONENTS} SELECT DISTINCT node_id, component FROM reach")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected(edges(spark, sf_dir))


@query("largest_component", f"WITH RECURSIVE {COMPONENTS}, size AS (SELECT component, count(*) AS n FROM reach GROUP BY component) SELECT node_id FROM reach WHERE component = (SELECT component FROM size ORDER BY n DESC, component LIMIT 1)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the component with the most nodes, of equally large ones that with the least node."""
    found = graph.connected(edges(spark, sf_dir))
    top = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return found.join(F.broadcast(top), "component", "left_semi").select("node_id")


@query("unroutable_buildings", f"WITH RECURSIVE {SNAPS}, {COMPONENTS[len(EDGES) + 2 :]}, size AS (SELECT component, count(*) AS n FROM reach GROUP BY component) SELECT id, node_id FROM snap WHERE node_id NOT IN (SELECT node_id FROM reach WHERE component = (SELECT component FROM size ORDER BY n DESC, component LIMIT 1))")
def unroutable_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose nearest walkway point isn't in the largest component."""
    return snaps(spark, sf_dir).join(largest_component(spark, sf_dir), "node_id", "left_anti").select("id", "node_id")
