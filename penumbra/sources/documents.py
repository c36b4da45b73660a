"""Reading of JSON documents and map extracts with fixed schemas, and writing of single documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators.graph import kept
from penumbra.sources import json_parts

#: Columns of normalised trees and buildings that are texts, and what is read as a number, by the name it has in a document.
TREE_TEXTS, TREE_NUMBERS = ("global_id", "common_name", "species", "health", "condition", "status"), ("height_m", "canopy_diameter_m", "canopy_radius_m")
BUILDING_TEXTS, BUILDING_NUMBERS = ("building_number", "abbreviation", "name", "status", "height_source"), ("estimated_height_m",)


def _pair(value: Column) -> Column:
    """A variant that is a pair of numbers as a point; else null."""
    x, y = (json_parts.lenient_number(json_parts.at(value, f"$[{i}]")) for i in (0, 1))
    pair = (json_parts.kind(value) == "list") & (F.size(F.try_variant_get(value, "$", "array<variant>")) == 2)
    return F.when(pair & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def _list(value: Column) -> Column:
    """A variant that is a list as an array of variants; else null."""
    return F.when(json_parts.kind(value) == "list", F.try_variant_get(value, "$", "array<variant>"))


def _features(rows: DataFrame, texts: tuple[str, ...], numbers: tuple[str, ...], shapes: list[Column]) -> DataFrame:
    """pos and typed columns of elements (pos, value), whatever they are: what is of the wrong type is null, and so is everything of an element that is no object.

    Each element is read by itself, so a bad one is a row that later checks leave out and count. shade_ready is true only for a true; a number may be written as text.
    """
    member = lambda name: json_parts.at(F.col("value"), f"$.{name}")
    source = json_parts.text_of(member("source_id")).alias("source_id")
    ready = ((json_parts.kind(member("shade_ready")) == "boolean") & F.coalesce(F.try_variant_get("value", "$.shade_ready", "boolean"), F.lit(False))).alias("shade_ready")
    flags = F.coalesce(F.transform(F.filter(_list(member("quality_flags")), lambda v: json_parts.kind(v) == "text"), lambda v: v.cast("string")), F.array().cast("array<string>")).alias("quality_flags")
    return rows.select("pos", source, *shapes, *[json_parts.text_of(member(t)).alias(t) for t in texts], *[json_parts.lenient_number(member(n)).alias(n) for n in numbers], F.coalesce(ready, F.lit(False)).alias("shade_ready"), flags)


def scan_trees(spark: SparkSession, path: str) -> DataFrame:
    """Normalised trees of a data set document, with points as structs, a row for each element of its list of trees."""
    rows = json_parts.elements(spark, path, "trees")
    edited = F.try_variant_get("value", "$.source_last_edited_at", "long").alias("source_last_edited_at")
    return _features(rows, TREE_TEXTS, TREE_NUMBERS, [_pair(json_parts.at(F.col("value"), f"$.{p}")).alias(p) for p in ("point_wgs84", "point_m")] + [edited])


def scan_buildings(spark: SparkSession, path: str) -> DataFrame:
    """Normalised buildings of a data set document, with rings of points, a row for each element of its list of buildings. A ring with anything but pairs is null."""

    def rings(name: str) -> Column:
        ring = lambda r: F.transform(_list(r), _pair)
        whole = lambda r: F.when(F.forall(ring(r), lambda p: p.isNotNull()), ring(r))
        return F.transform(_list(json_parts.at(F.col("value"), f"$.{name}")), whole).alias(name)

    rows = json_parts.elements(spark, path, "buildings")
    floors = F.try_variant_get("value", "$.floor_count", "int").alias("floor_count")
    # written, since all that follows names the rings many times over
    return kept(_features(rows, BUILDING_TEXTS, BUILDING_NUMBERS, [rings("footprint_wgs84"), rings("footprint_m"), floors]), "buildings")


def scan_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph document: positional arrays of numbers and a kind of way."""
    schema = "nodes array<array<double>>, edges array<array<string>>"
    document = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = document.select(F.explode("nodes").alias("n")).select(F.col("n")[0].cast("long").alias("node_id"), F.col("n")[1].alias("lat"), F.col("n")[2].alias("lon"))
    edges = document.select(F.explode("edges").alias("e")).select(F.col("e")[0].cast("long").alias("lo"), F.col("e")[1].cast("long").alias("hi"), F.col("e")[2].cast("double").alias("distance_m"), F.col("e")[3].alias("highway"))
    return nodes, edges


def scan_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of an OpenStreetMap extract in XML: way_id, pos, refs, tags (the last of a repeated key); node_id, lat, lon."""
    ways = spark.read.format("xml").option("rowTag", "way").schema("_id bigint, nd array<struct<_ref:bigint>>, tag array<struct<_k:string,_v:string>>").load(path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id bigint, _lat double, _lon double").load(path)
    pairs = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    last = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    return ways.select(F.col("_id").alias("way_id"), F.col("_id").alias("pos"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), last.alias("tags")), nodes.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))


#: Where an observation has what the checks read: column, path, and how it is read.
OBSERVED = (
    ("observation_id", "observation_id", "text"), ("observation_type", "observation_type", "text"), ("observed_at", "observed_at", "text"),
    ("latitude", "location.latitude", "number"), ("longitude", "location.longitude", "number"), ("gps_accuracy_m", "location.gps_accuracy_m", "number"),
    ("cloud_condition", "conditions.cloud_condition", "text"), ("object_type", "subject.object_type", "text"), ("source_feature_id", "subject.source_feature_id", "text"),
    ("origin_id", "route.origin_id", "text"), ("destination_id", "route.destination_id", "text"), ("preference", "route.preference", "text"),
    *[(f"{side}_{c}", f"{side}.{p}", "number") for side in ("observed", "predicted") for c, p in (
        ("bearing", "shadow_bearing_degrees"), ("length", "shadow_length_m"), ("shadow_fraction", "walkway_shade_fraction"), ("distance", "distance_m"), ("duration", "duration_seconds"), ("route_fraction", "shade_fraction"))],
)


def scan_observations(spark: SparkSession, path: str) -> DataFrame:
    """Field observations of a document, a row for each, with the columns that the checks read and `kinds`, which says what each path holds (absent ones are not in it).

    A version other than 1.0, or observations that are no list, are errors of the document; anything else is an error of one row. Values are strict: a number is no text
    and a truth no number, so such a value is null in its column and its kind tells what it was.
    """
    told = kept(json_parts.parts(spark, path), "parts")
    if json_parts.member(spark, path, "schema_version", told) != '"1.0"':
        raise ValueError("schema_version must be '1.0'")
    if json_parts.member(spark, path, "observations", told) != "[":
        raise ValueError("observations must be an array")
    rows = json_parts.elements(spark, path, "observations", told)
    paths = sorted({p for _, p, _ in OBSERVED} | {p.split(".")[0] for _, p, _ in OBSERVED} | {"evidence", "evidence.photo_files"})
    # each path is looked up once, in what holds it, and its schema is told once: columns of their own, since the plan repeats what an expression names more than once
    held = rows.select("pos", "value", *[json_parts.at(F.col("value"), f"$.{p}").alias(f"at {p}") for p in paths if "." not in p])
    held = held.select("*", *[json_parts.at(F.col(f"`at {p.split('.')[0]}`"), f"$.{p.split('.')[1]}").alias(f"at {p}") for p in paths if "." in p])
    held = held.select("*", *[F.schema_of_variant(F.col(f"`at {p}`")).alias(f"schema {p}") for p in paths], F.schema_of_variant("value").alias("schema"))
    kinds = [F.struct(F.lit("").alias("key"), F.coalesce(json_parts.kind(F.col("value"), F.col("schema")), F.lit("null")).alias("value"))]
    kinds += [F.struct(F.lit(p).alias("key"), json_parts.kind(F.col(f"`at {p}`"), F.col(f"`schema {p}`")).alias("value")) for p in paths]
    known = held.withColumn("kinds", F.map_from_entries(F.filter(F.array(*kinds), lambda e: e["value"].isNotNull())))
    read = {"text": "string", "number": "double"}
    typed = [F.when(json_parts.kind(F.col(f"`at {p}`"), F.col(f"`schema {p}`")) == of, F.try_variant_get(F.col(f"`at {p}`"), "$", read[of])).alias(c) for c, p, of in OBSERVED]
    files, of_files = F.col("`at evidence.photo_files`"), F.col("`schema evidence.photo_files`")
    photos = F.when(json_parts.kind(files, of_files) == "list", F.try_variant_get(files, "$", "array<variant>"))
    named = F.forall(photos, lambda f: (json_parts.kind(f) == "text") & (f.cast("string") != ""))
    found = known.select("pos", "kinds", *typed, F.when(named, F.size(photos)).when(json_parts.kind(files, of_files).isNotNull(), 0).alias("photos"))
    for side in ("observed", "predicted"):
        fraction = F.when(F.col("observation_type") == "route", F.col(f"{side}_route_fraction")).otherwise(F.col(f"{side}_shadow_fraction"))
        found = found.withColumn(f"{side}_fraction", fraction).drop(f"{side}_route_fraction", f"{side}_shadow_fraction")
    return found


def write_document(row: DataFrame, path: str) -> None:
    """Writes a one-row DataFrame as a single compact JSON document, in one file below path."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Writes pieces (section, pos, text), in order, as one document at path, wherever Spark can write.

    Tasks write ranges of them side by side; when all are done, the ranges' files are copied behind one another, a buffer at a time, to a name of their own, which becomes
    path at the end. So no task and not the driver holds the document, and a write that fails leaves nothing, neither at path nor beside it.
    """
    spark = pieces.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, folder, joined = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.parts-{uuid.uuid4().hex}", f"{path}.whole-{uuid.uuid4().hex}"))
    files = target.getFileSystem(conf)
    try:
        pieces.orderBy("section", "pos").select("text").write.text(str(folder))
        parts = sorted((str(x.getPath()) for x in files.listStatus(folder) if x.getPath().getName().startswith("part-")))
        out = files.create(joined, True)
        try:
            for part in parts:
                held = files.open(jvm.org.apache.hadoop.fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
                finally:
                    held.close()
        finally:
            out.close()
        if files.exists(target):
            files.delete(target, False)
        if not files.rename(joined, target):
            raise OSError(f"{path} could not be written")
    finally:
        for own in (folder, joined):
            files.delete(own, True)
