"""Queries that clean and normalise raw features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import geo, text
from penumbra.operators import ingest
from penumbra.operators.graph import spread
from penumbra.plans.tables import BUILDINGS, EAST, NORTH, SOUTH, TREES, WEST, raw_buildings, raw_trees
from penumbra.registry import query


def utm_sql(source: str, lon: str, lat: str, keep: str) -> str:
    """CTEs that end in `utm`: keep, e, n (null outside of the projection)."""
    return f"""
u1 AS (SELECT {keep}, {lon} AS ulon, {lat} AS ulat, radians({lat}) AS phi, 0.00669438e0 AS e2 FROM {source}),
u2 AS (SELECT *, e2 / (1 - e2) AS ep, pow(tan(phi), 2) AS t, cos(phi) * radians(ulon + 99) AS a, 6378137e0 / sqrt(1 - e2 * pow(sin(phi), 2)) AS rad FROM u1),
u3 AS (SELECT *, ep * pow(cos(phi), 2) AS c, 6378137e0 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi)
  + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - (35 * e2 ** 3 / 3072) * sin(6 * phi)) AS arc FROM u2),
utm AS (SELECT {keep}, CASE WHEN ulon BETWEEN -180 AND 180 AND ulat BETWEEN -80 AND 84 THEN 0.9996e0 * rad * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120) + 500000 END AS e,
  CASE WHEN ulon BETWEEN -180 AND 180 AND ulat BETWEEN -80 AND 84 THEN 0.9996e0 * (arc + rad * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720))
    + CASE WHEN ulat < 0 THEN 10000000 ELSE 0 END END AS n FROM u3)"""


def clean_sql(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


def number_sql(x: str) -> str:
    return f"CASE WHEN TRY_CAST({clean_sql(x)} AS DOUBLE) > 0 THEN TRY_CAST({clean_sql(x)} AS DOUBLE) END"


TREES_CLEAN = f"""{TREES}, {utm_sql("raw_tree", "x", "y", "objectid, common_name, species, height, canopy_spread, health, status, date_removed, x, y")}, tree1 AS (
  SELECT objectid AS source_id, round(e, 3) AS e, round(n, 3) AS n, round(x, 7) AS lon, round(y, 7) AS lat, {clean_sql("common_name")} AS common_name, {clean_sql("species")} AS species,
    {number_sql("height")} AS feet, {number_sql("canopy_spread")} AS spread, {clean_sql("health")} AS health, {clean_sql("status")} AS status, date_removed IS NOT NULL AS removed
  FROM utm
), tree AS (
  SELECT *, round(feet * 0.3048e0, 3) AS height_m, round(spread * 0.3048e0, 3) AS canopy_diameter_m, round(spread * 0.3048e0 / 2, 3) AS canopy_radius_m,
    e IS NOT NULL AND feet IS NOT NULL AND spread IS NOT NULL AND coalesce(lower(status) <> 'dead', true) AND NOT removed AS shade_ready,
    list_filter([CASE WHEN e IS NULL THEN 'invalid_geometry' END, CASE WHEN feet IS NULL THEN 'missing_height' END, CASE WHEN spread IS NULL THEN 'missing_canopy_spread' END,
      CASE WHEN health IS NULL THEN 'health_unknown' END, CASE WHEN status IS NULL THEN 'status_unknown' END, CASE WHEN lower(status) = 'dead' THEN 'dead' END, CASE WHEN removed THEN 'removed' END], lambda f: f IS NOT NULL) AS flags
  FROM tree1)"""
BUILDINGS_CLEAN = f"""{BUILDINGS}, building1 AS (
  SELECT objectid AS source_id, {clean_sql("number")} AS building_number, {clean_sql("abbreviation")} AS abbreviation, {clean_sql("name")} AS name,
    TRY_CAST({clean_sql("floors")} AS INTEGER) AS floor_count, rings, len(rings) > 0 AS good FROM raw_building
), building AS (
  SELECT *, round(floor_count * 3.5e0, 3) AS estimated_height_m, floor_count IS NOT NULL AND good AS shade_ready,
    list_filter([CASE WHEN NOT good THEN 'invalid_geometry' END, CASE WHEN floor_count IS NULL THEN 'missing_floor_count' END, CASE WHEN floor_count IS NOT NULL THEN 'height_estimated_from_floors' END], lambda f: f IS NOT NULL) AS flags
  FROM building1)"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize_trees(spread(raw_trees(spark, sf_dir)))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize_buildings(spread(raw_buildings(spark, sf_dir)))


@query("clean_text", f"WITH {TREES} SELECT objectid, {clean_sql('species')} AS species, {clean_sql('health')} AS health FROM raw_tree")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_trees(spark, sf_dir).select("objectid", text.clean_text(F.col("species")).alias("species"), text.clean_text(F.col("health")).alias("health"))


@query("positive_number", f"WITH {TREES} SELECT objectid, {number_sql('height')} AS height, {number_sql('canopy_spread')} AS spread FROM raw_tree")
def positive_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_trees(spark, sf_dir).select("objectid", text.positive_number(F.col("height")).alias("height"), text.positive_number(F.col("canopy_spread")).alias("spread"))


@query("positive_integer", f"WITH {BUILDINGS} SELECT objectid, TRY_CAST({clean_sql('floors')} AS INTEGER) AS floors FROM raw_building")
def positive_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_buildings(spark, sf_dir).select("objectid", text.positive_integer(F.col("floors")).alias("floors"))


@query("utm_project", f"WITH {TREES}, {utm_sql('raw_tree', 'x', 'y', 'objectid')} SELECT objectid, round(e, 3) AS e, round(n, 3) AS n FROM utm")
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geo.utm14(F.col("x"), F.col("y"))
    return raw_trees(spark, sf_dir).select("objectid", F.round(m["x"], 3).alias("e"), F.round(m["y"], 3).alias("n"))


@query(
    "normalize_tree",
    f"WITH {TREES_CLEAN} SELECT source_id, common_name, species, lon, lat, e, n, height_m, canopy_diameter_m, canopy_radius_m, health, status, shade_ready, array_to_string(flags, '|') AS flags FROM tree",
)
def normalize_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir).select(
        "source_id", "common_name", "species", F.col("point_wgs84.x").alias("lon"), F.col("point_wgs84.y").alias("lat"), F.col("point_m.x").alias("e"), F.col("point_m.y").alias("n"),
        "height_m", "canopy_diameter_m", "canopy_radius_m", "health", "status", "shade_ready", F.array_join("quality_flags", "|").alias("flags"),
    )


@query(
    "normalize_building",
    f"WITH {BUILDINGS_CLEAN} SELECT source_id, building_number, abbreviation, name, floor_count, estimated_height_m, shade_ready, array_to_string(flags, '|') AS flags FROM building",
)
def normalize_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir).select("source_id", "building_number", "abbreviation", "name", "floor_count", "estimated_height_m", "shade_ready", F.array_join("quality_flags", "|").alias("flags"))


POINTS = f"""{BUILDINGS}, ring AS (SELECT objectid, generate_subscripts(rings, 1) AS ring, unnest(rings) AS points FROM raw_building),
vertex AS (SELECT objectid, ring, generate_subscripts(points, 1) AS pos, unnest(points) AS p FROM ring), {utm_sql("vertex", "p.x", "p.y", "objectid, ring, pos")}"""


@query("normalize_rings", f"WITH {POINTS} SELECT objectid, ring, pos, round(e, 3) AS e, round(n, 3) AS n FROM utm")
def normalize_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = raw_buildings(spark, sf_dir).select("objectid", ingest.normalize_rings(F.col("rings"))["metric"].alias("m"))
    each = rings.select("objectid", F.posexplode("m").alias("ring", "points")).select("objectid", "ring", F.posexplode("points").alias("pos", "p"))
    return each.select("objectid", (F.col("ring") + 1).cast("long").alias("ring"), (F.col("pos") + 1).cast("long").alias("pos"), F.col("p.x").alias("e"), F.col("p.y").alias("n"))


@query("quality_summary", f"WITH {TREES_CLEAN} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM tree) GROUP BY flag")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.quality_summary(trees(spark, sf_dir))


@query("quality_summary_buildings", f"WITH {BUILDINGS_CLEAN} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM building) GROUP BY flag")
def quality_summary_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.quality_summary(buildings(spark, sf_dir))


SUMMARY = f"{TREES_CLEAN}, {BUILDINGS_CLEAN}"


@query(
    "ingest_summary",
    f"WITH {SUMMARY} SELECT 'trees' AS kind, count(*) AS total, count(*) FILTER (shade_ready) AS ready FROM tree UNION ALL SELECT 'buildings', count(*), count(*) FILTER (shade_ready) FROM building",
)
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counts(trees(spark, sf_dir), "trees").unionByName(ingest.counts(buildings(spark, sf_dir), "buildings"))


@query(
    "ingest_envelope",
    f"""WITH {SUMMARY} SELECT CAST(1 AS INTEGER) AS schema_version, '2026-08-30T15:15:00Z' AS generated_at, 'map service' AS source_name, 'https://maps.example/rest' AS service_url, 'buildings 1 Buildings|trees 4 Trees' AS layers, 'EPSG:4326' AS source_crs, 'EPSG:32614' AS target_crs,
  'feet' AS tree_dimension_source_unit, 'assumed; source metadata does not declare units' AS tree_dimension_unit_status,
  '-96.346,30.609,-96.338,30.6225' AS bbox, 0.3048e0 AS feet_to_metres, 3.5e0 AS floor_height_m, (SELECT count(*) FROM tree) AS trees_total, (SELECT count(*) FILTER (shade_ready) FROM tree) AS trees_ready,
  (SELECT count(*) FROM building) AS buildings_total, (SELECT count(*) FILTER (shade_ready) FROM building) AS buildings_ready,
  (SELECT string_agg(flag || '=' || n, '|' ORDER BY flag) FROM (SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM tree) GROUP BY flag)) AS trees_flags,
  (SELECT string_agg(flag || '=' || n, '|' ORDER BY flag) FROM (SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM building) GROUP BY flag)) AS buildings_flags""",
)
def ingest_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2026-08-30 15:15:00").cast("timestamp_ntz")
    layers = {"trees": (4, "Trees"), "buildings": (1, "Buildings")}
    row = ingest.envelope(trees(spark, sf_dir), buildings(spark, sf_dir), at, (WEST, SOUTH, EAST, NORTH), ("map service", "https://maps.example/rest"), layers)
    counted = lambda name: F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("layers")), lambda e: F.concat_ws(" ", e["key"], e["value"]["id"].cast("string"), e["value"]["name"])), "|")
    return row.withColumn("layers", listed).withColumn("trees_flags", counted("trees_flags")).withColumn("buildings_flags", counted("buildings_flags"))


@query("bbox_filter", f"WITH {TREES} SELECT objectid, x, y FROM raw_tree WHERE x BETWEEN -96.344e0 AND -96.340e0 AND y BETWEEN 30.612e0 AND 30.62e0")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees in a box: plain ranges, which reach a Parquet scan of stored coordinates."""
    return raw_trees(spark, sf_dir).filter(F.col("x").between(-96.344, -96.340) & F.col("y").between(30.612, 30.62)).select("objectid", "x", "y")


@query(
    "tree_eligible",
    f"WITH {TREES_CLEAN} SELECT source_id, e, n, height_m, canopy_radius_m, (SELECT count(*) FROM tree) - count(*) OVER () AS excluded FROM tree WHERE shade_ready",
)
def tree_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.operators.shadows import eligible_trees, tree_throws

    rows = trees(spark, sf_dir)
    excluded = rows.agg(F.count_if(~tree_throws()).alias("excluded"))
    return eligible_trees(rows).join(F.broadcast(excluded)).select("source_id", F.col("point_m.x").alias("e"), F.col("point_m.y").alias("n"), "height_m", "canopy_radius_m", "excluded")


@query("building_eligible", f"WITH {BUILDINGS_CLEAN} SELECT source_id, estimated_height_m AS height_m, CAST(len(rings) AS BIGINT) AS rings FROM building WHERE shade_ready")
def building_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penumbra.operators.shadows import eligible_buildings

    return eligible_buildings(buildings(spark, sf_dir).withColumn("pos", F.col("source_id"))).select("source_id", "height_m", F.size("footprint_m").cast("long").alias("rings"))


@query(
    "ring_area",
    f"""WITH {POINTS}, m AS (SELECT *, round(e, 3) - 755000 AS x, round(n, 3) - 3390000 AS y FROM utm), s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM m WINDOW w AS (PARTITION BY objectid, ring ORDER BY pos))
SELECT objectid, ring, round(abs(sum(x * y2 - x2 * y)) / 2, 2) AS area_m2 FROM s GROUP BY objectid, ring""",
)
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = raw_buildings(spark, sf_dir).select("objectid", F.posexplode(ingest.normalize_rings(F.col("rings"))["metric"]).alias("ring", "points"))
    near = F.transform("points", lambda p: geo.point(p["x"] - 755000, p["y"] - 3390000))
    return rings.select("objectid", (F.col("ring") + 1).cast("long").alias("ring"), F.round(F.abs(geo.ring_area_twice(near)) / 2, 2).alias("area_m2"))


CENTER = f"""{BUILDINGS}, vertex AS (SELECT objectid, generate_subscripts(rings[1], 1) AS pos, unnest(rings[1]) AS p FROM raw_building WHERE len(rings) > 0),
side AS (SELECT objectid, p.x AS x, p.y AS y, lead(p.x) OVER w AS x2, lead(p.y) OVER w AS y2 FROM vertex WINDOW w AS (PARTITION BY objectid ORDER BY pos)),
center AS (SELECT objectid, sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS lon, sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS lat FROM side GROUP BY objectid)"""


@query("footprint_center", f"WITH {CENTER} SELECT objectid, round(lon, 4) AS lon, round(lat, 4) AS lat FROM center")
def footprint_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geo.footprint_center(F.col("rings"))
    return raw_buildings(spark, sf_dir).filter(F.size("rings") > 0).select("objectid", F.round(c["x"], 4).alias("lon"), F.round(c["y"], 4).alias("lat"))
