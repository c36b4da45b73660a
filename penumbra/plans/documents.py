"""Queries on documents: the domain's tables are written as one JSON document each, by tasks side by side, and read again element by element."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators.graph import shared_base, spread
from penumbra.plans.ingest import BUILDINGS_CLEAN, TREES_CLEAN, buildings, trees
from penumbra.plans.tables import OBSERVATIONS, observations
from penumbra.registry import query
from penumbra.sources import documents


def written(rows: DataFrame, name: str, pos: Column, element: Column) -> str:
    """The path of a new document with rows as its list `name`, between a version and a member that is no list."""
    spark = rows.sparkSession
    first = F.broadcast(rows.agg(F.min(pos).alias("__first")))
    text = F.concat(F.when(pos == F.col("__first"), "").otherwise(","), F.to_json(element, {"ignoreNullFields": "false"}))
    fixed = spark.createDataFrame([(0, 0, '{"schema_version":"1.0","%s":[' % name), (2, 0, '],"about":{"made":"for a query, [from] a table"}}')], "section int, pos long, text string")
    pieces = fixed.unionByName(rows.crossJoin(first).select(F.lit(1).alias("section"), pos.cast("long").alias("pos"), text.alias("text")))
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}.json"
    documents.write_pieces(pieces, path)
    return path


def _pair(p: Column) -> Column:
    return F.when(p.isNotNull(), F.array(p["x"], p["y"]))


@query("scan_trees", f"WITH {TREES_CLEAN} SELECT row_number() OVER (ORDER BY source_id) - 1 AS pos, CAST(source_id AS VARCHAR) AS source_id, common_name, e AS x, n AS y, lon, lat, height_m, canopy_radius_m, shade_ready, len(flags) AS flags FROM tree")
def scan_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised trees after they were a document."""
    rows = trees(spark, sf_dir)
    element = F.struct("source_id", _pair(F.col("point_wgs84")).alias("point_wgs84"), _pair(F.col("point_m")).alias("point_m"), "common_name", "species", "height_m", "canopy_diameter_m", "canopy_radius_m", "health", "status", "shade_ready", "quality_flags")
    found = documents.scan_trees(spark, written(rows, "trees", F.col("source_id"), element))
    return found.select("pos", "source_id", "common_name", "point_m.x", "point_m.y", F.col("point_wgs84.x").alias("lon"), F.col("point_wgs84.y").alias("lat"), "height_m", "canopy_radius_m", "shade_ready", F.size("quality_flags").cast("long").alias("flags"))


@query("scan_buildings", f"WITH {BUILDINGS_CLEAN} SELECT row_number() OVER (ORDER BY source_id) - 1 AS pos, CAST(source_id AS VARCHAR) AS source_id, name, building_number, estimated_height_m, shade_ready, CASE WHEN good THEN len(rings) END AS rings, CASE WHEN good THEN CAST(list_sum(list_transform(rings, lambda r: len(r))) AS BIGINT) END AS points FROM building")
def scan_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised buildings after they were a document; one without a sound footprint has none there either."""
    rows = buildings(spark, sf_dir)
    rings = lambda c: F.transform(c, lambda r: F.transform(r, _pair)).alias(c)
    element = F.struct("source_id", "building_number", "abbreviation", "name", "floor_count", "estimated_height_m", "height_source", rings("footprint_wgs84"), rings("footprint_m"), "shade_ready", "quality_flags")
    found = documents.scan_buildings(spark, written(rows, "buildings", F.col("source_id"), element))
    points = F.aggregate("footprint_m", F.lit(0).cast("long"), lambda n, r: n + F.size(r))
    return found.select("pos", "source_id", "name", "building_number", "estimated_height_m", "shade_ready", F.size("footprint_m").cast("long").alias("rings"), points.alias("points"))


@query("scan_observations", f"WITH {OBSERVATIONS} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, observation_id, observation_type, observed_at, latitude, gps_accuracy_m, photos, object_type, destination_id, CASE WHEN destination_id IS NULL THEN 'null' ELSE 'text' END AS destination_kind, predicted_distance FROM obs")
def scan_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field observations after they were a document, with what the document holds where a destination should be."""
    rows = spread(observations(spark, sf_dir))
    c = F.col
    side = lambda s: F.struct(c(f"{s}_bearing").alias("shadow_bearing_degrees"), c(f"{s}_length").alias("shadow_length_m"), c(f"{s}_fraction").alias("walkway_shade_fraction"), c(f"{s}_fraction").alias("shade_fraction"), c(f"{s}_distance").alias("distance_m"), c(f"{s}_duration").alias("duration_seconds")).alias(s)
    photos = F.when(c("photos") > 0, F.transform(F.sequence(F.lit(1), c("photos").cast("int")), lambda i: F.concat(i.cast("string"), F.lit(".jpg")))).otherwise(F.array().cast("array<string>"))
    element = F.struct(
        "observation_id", "observation_type", "observed_at", F.struct("latitude", "longitude", "gps_accuracy_m").alias("location"), F.struct("cloud_condition").alias("conditions"), F.struct(photos.alias("photo_files")).alias("evidence"),
        F.struct("object_type", "source_feature_id").alias("subject"), F.struct("origin_id", "destination_id", "preference").alias("route"), side("observed"), side("predicted"),
    )
    found = documents.scan_observations(spark, written(rows, "observations", c("pos"), element))
    return found.select("pos", "observation_id", "observation_type", "observed_at", "latitude", "gps_accuracy_m", c("photos").cast("long").alias("photos"), "object_type", "destination_id", c("kinds")["route.destination_id"].alias("destination_kind"), "predicted_distance")
