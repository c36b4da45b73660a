"""The domain's tables, derived from the general test tables by closed formulas.

The formulas of scalar columns are SQL that Spark and the comparison database read alike; everything that is computed from them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEST, SOUTH, EAST, NORTH = -96.346, 30.609, -96.338, 30.6225

#: Raw attributes of trees, by the number k of a part.
TREE_COLUMNS = {
    "objectid": "k",
    "common_name": "p_name",
    "species": "concat(' ', p_type, ' ')",
    "height": "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 19 = 0 THEN '  ' ELSE concat(' ', CAST(p_size + 10 AS STRING), ' ') END",
    "canopy_spread": "CASE WHEN k % 13 = 0 THEN '0' WHEN k % 37 = 0 THEN 'wide' ELSE CAST(k % 40 + 5 AS STRING) END",
    "health": "CASE k % 4 WHEN 3 THEN NULL WHEN 0 THEN 'Good' WHEN 1 THEN ' Fair ' ELSE '' END",
    "status": "CASE k % 5 WHEN 4 THEN NULL WHEN 3 THEN ' Dead' ELSE 'Alive' END",
    "date_removed": "CASE WHEN k % 17 = 0 THEN 1710000000000 + k END",
    "x": "CASE WHEN k % 23 = 0 THEN NULL ELSE -96.346e0 + 8e-3 * ((k * 7919) % 10007) / 10007e0 END",
    "y": "CASE WHEN k % 23 = 0 THEN NULL ELSE 30.609e0 + 135e-4 * ((k * 104729) % 10009) / 10009e0 END",
}
#: Raw attributes of buildings, by the number k of a supplier; w0, s0 is the south-west corner, w and h are the size in degrees.
#: Every 13th stands on the next one's corner, so that places share their access.
BUILDING_COLUMNS = {
    "objectid": "k",
    "number": "concat(' ', lpad(CAST(k AS STRING), 4, '0'), ' ')",
    "abbreviation": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '12.5' ELSE concat('B', CAST(k AS STRING)) END",
    "name": "CASE WHEN k % 29 = 5 THEN '  ' ELSE concat(' ', s_name, ' ') END",
    "floors": "CASE k % 9 WHEN 0 THEN ' ' ELSE CAST(k % 9 AS STRING) END",
    "w0": "-96.346e0 + 78e-4 * ((CASE WHEN k % 13 = 1 THEN k + 1 ELSE k END * 6151) % 9973) / 9973e0",
    "s0": "30.609e0 + 133e-4 * ((CASE WHEN k % 13 = 1 THEN k + 1 ELSE k END * 7823) % 9967) / 9967e0",
    "w": "2e-4 + 2e-5 * (k % 5)",
    "h": "15e-5 + 2e-5 * (k % 7)",
}
#: A grid of walkway nodes, by the number k of a customer of n.
NODE_COLUMNS = {
    "node_id": "k",
    "r": "r",
    "c": "c",
    "side": "side",
    "n": "n",
    "lon": "-96.346e0 + 8e-3 * c / side + 1e-4 * ((k * 7919) % 101) / 101e0",
    "lat": "30.609e0 + 135e-4 * r / side + 1e-4 * ((k * 104729) % 103) / 103e0",
}
OBSERVATION_COLUMNS = {
    "observation_id": "concat('obs-', CAST(CASE WHEN k % 101 = 7 THEN k - 1 ELSE k END AS STRING))",
    "pos": "k",
    "observation_type": "CASE WHEN k % 53 = 11 THEN 'photo' WHEN k % 2 = 0 THEN 'shadow' ELSE 'route' END",
    "observed_at": "concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T13:15:00', CASE k % 43 WHEN 3 THEN '' WHEN 4 THEN 'Z' WHEN 5 THEN ' noon' ELSE '-05:00' END)",
    "latitude": "CASE WHEN k % 97 = 5 THEN 95e0 ELSE 30.6e0 + (k % 10) / 100e0 END",
    "longitude": "CASE WHEN k % 89 = 6 THEN -200e0 ELSE -96.3e0 END",
    "gps_accuracy_m": "CASE WHEN k % 83 = 9 THEN -1e0 ELSE (k % 7) / 2e0 END",
    "cloud_condition": "CASE WHEN k % 41 = 2 THEN 'fog' WHEN k % 3 = 0 THEN 'clear' WHEN k % 3 = 1 THEN 'partly_cloudy' ELSE 'overcast' END",
    "photos": "k % 5",
    "object_type": "CASE WHEN k % 61 = 10 THEN 'pole' WHEN k % 4 = 0 THEN 'tree' ELSE 'building' END",
    "source_feature_id": "CASE WHEN k % 67 = 12 THEN ' ' ELSE CAST(k AS STRING) END",
    "origin_id": "concat('node-', CAST(k % 40 AS STRING))",
    "destination_id": "CASE WHEN k % 71 = 14 THEN NULL ELSE concat('node-', CAST(k % 41 AS STRING)) END",
    "preference": "CASE WHEN k % 73 = 15 THEN 'scenic' WHEN k % 3 = 0 THEN 'fastest' ELSE 'shadiest' END",
    "observed_bearing": "(k % 360) * 1e0",
    "predicted_bearing": "((k * 7 + 13) % 360) + 5e-1",
    "observed_length": "CASE WHEN k % 10 = 0 THEN 0e0 ELSE o_totalprice / 1e4 END",
    "predicted_length": "o_totalprice / 11e3 + (k % 5)",
    "observed_fraction": "CASE WHEN k % 79 = 20 THEN 15e-1 ELSE (k % 100) / 100e0 END",
    "predicted_fraction": "((k * 3) % 100) / 100e0",
    "observed_distance": "o_totalprice / 100e0",
    "predicted_distance": "o_totalprice / 97e0 + (k % 11)",
    "observed_duration": "o_totalprice / 140e0",
    "predicted_duration": "o_totalprice / 137e0 + (k % 13)",
}


def columns(of: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in of.items()]


def _cte(of: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(columns(of))} FROM {source}"


#: The same tables for the comparison database; rings are lists of lists of structs.
def _p(x: str, y: str) -> str:
    return f"{{'x': {x}, 'y': {y}}}"


_BOX = ", ".join(_p(*p) for p in (("w0", "s0"), ("w0 + w", "s0"), ("w0 + w", "s0 + h"), ("w0", "s0 + h"), ("w0", "s0")))
_WING = ", ".join(_p(*p) for p in (("w0", "s0"), ("w0 + w", "s0"), ("w0 + w", "s0 + h / 2"), ("w0 + w / 2", "s0 + h / 2"), ("w0 + w / 2", "s0 + h"), ("w0", "s0 + h"), ("w0", "s0")))
_YARD = ", ".join(_p(*p) for p in (("w0 + w / 4", "s0 + h / 4"), ("w0 + w / 4", "s0 + h * 3 / 4"), ("w0 + w * 3 / 4", "s0 + h * 3 / 4"), ("w0 + w * 3 / 4", "s0 + h / 4"), ("w0 + w / 4", "s0 + h / 4")))
TREES = f"raw_tree AS ({_cte(TREE_COLUMNS, '(SELECT *, p_partkey AS k FROM part)')})"
BUILDINGS = f"""raw_box AS ({_cte(BUILDING_COLUMNS, "(SELECT *, s_suppkey AS k FROM supplier)")}), raw_building AS (
  SELECT *, CASE WHEN objectid % 31 = 30 THEN [] WHEN objectid % 4 = 1 THEN [[{_WING}]] WHEN objectid % 3 = 0 THEN [[{_BOX}], [{_YARD}]] ELSE [[{_BOX}]] END AS rings FROM raw_box)"""
NODES = f"""grid AS (SELECT k, n, side, CAST(floor(k / side) AS BIGINT) AS r, k - CAST(floor(k / side) AS BIGINT) * side AS c
  FROM (SELECT c_custkey AS k, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS side FROM customer)), node AS ({_cte(NODE_COLUMNS, "grid")})"""
DISTANCE = "2 * 6371000e0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"
EDGES = f"""{NODES}, edge AS (
  SELECT a.node_id AS lo, b.node_id AS hi, round({DISTANCE.format(a="a", b="b")}, 2) AS distance_m, CASE WHEN a.node_id % 3 = 0 THEN 'path' ELSE 'footway' END AS highway
  FROM node a JOIN node b ON (b.node_id = a.node_id + 1 AND b.r = a.r AND (a.node_id * 31) % 10 <> 0) OR (b.node_id = a.node_id + a.side AND (a.node_id * 17) % 9 <> 0)
  WHERE (a.r < a.side // 8 + 2 AND a.c < a.side // 8 + 2) = (b.r < b.side // 8 + 2 AND b.c < b.side // 8 + 2))"""
OBSERVATIONS = f"obs AS ({_cte(OBSERVATION_COLUMNS, '(SELECT *, o_orderkey AS k FROM orders)')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).selectExpr(*columns(TREE_COLUMNS))


def raw_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey")).selectExpr(*columns(BUILDING_COLUMNS))
    w0, s0, w, h = (F.col(x) for x in ("w0", "s0", "w", "h"))

    def shape(*rings):
        return F.array(*rings)

    box = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w0, s0), (w0 + w, s0), (w0 + w, s0 + h), (w0, s0 + h), (w0, s0))])
    wing = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w0, s0), (w0 + w, s0), (w0 + w, s0 + h / 2), (w0 + w / 2, s0 + h / 2), (w0 + w / 2, s0 + h), (w0, s0 + h), (w0, s0))])
    yard = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w0 + w / 4, s0 + h / 4), (w0 + w / 4, s0 + h * 3 / 4), (w0 + w * 3 / 4, s0 + h * 3 / 4), (w0 + w * 3 / 4, s0 + h / 4), (w0 + w / 4, s0 + h / 4))])
    kind = F.col("objectid")
    rings = F.when(kind % 31 == 30, F.array().cast("array<array<struct<x:double,y:double>>>")).when(kind % 4 == 1, shape(wing)).when(kind % 3 == 0, shape(box, yard)).otherwise(shape(box))
    return boxes.withColumn("rings", rings)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lon, lat and the place in the grid."""
    customers = table(spark, sf_dir, "customer")
    n = customers.count()
    side = max(1, int(-(-(n**0.5) // 1)))
    k = customers.select(F.col("c_custkey").alias("k"), F.lit(n).cast("long").alias("n"), F.lit(side).cast("long").alias("side"))
    grid = k.withColumn("r", F.floor(F.col("k") / F.col("side"))).withColumn("c", F.col("k") - F.col("r") * F.col("side"))
    return grid.selectExpr(*columns(NODE_COLUMNS))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi, distance_m, highway: neighbours to the right and below, some left out, and none into the south-western corner. One join on the neighbour's id."""
    from penumbra.functions.geo import haversine

    node = nodes(spark, sf_dir)
    k = F.col("node_id")
    right = F.when((k * 31) % 10 != 0, k + 1)
    below = F.when((k * 17) % 9 != 0, k + F.col("side"))
    wide = F.floor(F.col("side") / 8) + 2
    corner = ((F.col("r") < wide) & (F.col("c") < wide)).alias("corner")
    ends = node.select("node_id", "r", corner, "lon", "lat", F.explode(F.array(F.struct(right.alias("to"), F.lit(True).alias("row")), F.struct(below.alias("to"), F.lit(False).alias("row")))).alias("e"))
    other = node.select(F.col("node_id").alias("hi"), F.col("r").alias("r2"), corner.alias("corner2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    met = ends.join(other, F.col("e.to") == F.col("hi")).filter((~F.col("e.row") | (F.col("r") == F.col("r2"))) & (F.col("corner") == F.col("corner2")))
    distance = F.round(haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 2)
    return met.select(F.col("node_id").alias("lo"), "hi", distance.alias("distance_m"), F.when(F.col("node_id") % 3 == 0, "path").otherwise("footway").alias("highway"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).selectExpr(*columns(OBSERVATION_COLUMNS))
