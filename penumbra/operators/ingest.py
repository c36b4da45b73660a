"""Normalisation of raw tree and building features: text cleaned, units metric, missing values kept and flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import geo
from penumbra.functions.text import clean_text, positive_integer, positive_number

FEET, FLOOR_M, SCHEMA_VERSION = 0.3048, 3.5, 1
UNIT_STATUS = "assumed; source metadata does not declare units"
TREE_FLAGS = ("dead", "health_unknown", "invalid_geometry", "missing_canopy_spread", "missing_height", "removed", "status_unknown")
BUILDING_FLAGS = ("height_estimated_from_floors", "invalid_geometry", "missing_floor_count")


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named]))


def once(rows: DataFrame) -> DataFrame:
    """rows by way of a list of one: filters on a column stay behind it, so that what the column is computed from is not computed again for each of them."""
    return rows.select(F.inline_outer(F.array(F.struct(*rows.columns))))


def normalize_trees(raw: DataFrame) -> DataFrame:
    """From objectid, common_name, species, height and canopy_spread (feet, as text), health, status, date_removed, x and y (degrees).

    Ready for shade: a point, a height and a canopy, neither dead nor removed. Any non-null removal date counts, 0 included.
    """
    metric = geo.utm14(F.col("x"), F.col("y"))
    # said by ranges alone, so that filters on it needn't project
    placed = F.coalesce(F.col("x").between(-180, 180) & F.col("y").between(-80, 84), F.lit(False))
    # in steps, since Java compiles no method that says all of it at once
    located = once(raw.select(
        F.col("objectid").alias("source_id"),
        F.when(placed, geo.point(F.round("x", 7), F.round("y", 7))).alias("point_wgs84"),
        F.when(placed, geo.point(F.round(metric["x"], 3), F.round(metric["y"], 3))).alias("point_m"),
        "common_name", "species", "height", "canopy_spread", "health", "status",
        F.col("date_removed").isNotNull().alias("removed"),
        placed.alias("placed"),
    ))
    clean = once(located.select(
        "source_id", "point_wgs84", "point_m",
        clean_text(F.col("common_name")).alias("common_name"),
        clean_text(F.col("species")).alias("species"),
        positive_number(F.col("height")).alias("feet"),
        positive_number(F.col("canopy_spread")).alias("spread"),
        clean_text(F.col("health")).alias("health"),
        clean_text(F.col("status")).alias("status"),
        "removed", "placed",
    ))
    dead = F.coalesce(F.lower("status") == "dead", F.lit(False))
    found = flags(
        ("invalid_geometry", ~F.col("placed")),
        ("missing_height", F.col("feet").isNull()),
        ("missing_canopy_spread", F.col("spread").isNull()),
        ("health_unknown", F.col("health").isNull()),
        ("status_unknown", F.col("status").isNull()),
        ("dead", dead),
        ("removed", F.col("removed")),
    )
    ready = F.col("placed") & F.col("feet").isNotNull() & F.col("spread").isNotNull() & ~dead & ~F.col("removed")
    return once(clean.select(
        "source_id", "point_wgs84", "point_m", "common_name", "species",
        F.round(F.col("feet") * FEET, 3).alias("height_m"),
        F.round(F.col("spread") * FEET, 3).alias("canopy_diameter_m"),
        F.round(F.col("spread") * FEET / 2, 3).alias("canopy_radius_m"),
        "health", "status",
        ready.alias("shade_ready"),
        found.alias("quality_flags"),
    ))


def normalize_rings(rings: Column) -> Column:
    """(wgs84, metric) rings, to 7 and 3 places; null unless there are rings and each has four points or more that can be projected."""
    good = (F.size(rings) > 0) & F.forall(rings, lambda r: (F.size(r) >= 4) & F.forall(r, lambda p: F.coalesce(p["x"].between(-180, 180) & p["y"].between(-80, 84), F.lit(False))))

    def metric(p: Column) -> Column:
        m = geo.utm14(p["x"], p["y"])
        return geo.point(F.round(m["x"], 3), F.round(m["y"], 3))

    wgs84 = F.transform(rings, lambda r: F.transform(r, lambda p: geo.point(F.round(p["x"], 7), F.round(p["y"], 7))))
    return F.when(good, F.struct(wgs84.alias("wgs84"), F.transform(rings, lambda r: F.transform(r, metric)).alias("metric")))


def normalize_buildings(raw: DataFrame, floor_height_m: float = FLOOR_M) -> DataFrame:
    """From objectid, number, abbreviation, name, floors (text) and rings. Heights are floors times floor_height_m, and flagged as such."""
    clean = raw.select(
        F.col("objectid").alias("source_id"),
        clean_text(F.col("number")).alias("building_number"),
        clean_text(F.col("abbreviation")).alias("abbreviation"),
        clean_text(F.col("name")).alias("name"),
        positive_integer(F.col("floors")).alias("floor_count"),
        normalize_rings(F.col("rings")).alias("footprint"),
    )
    found = flags(("invalid_geometry", F.col("footprint").isNull()), ("missing_floor_count", F.col("floor_count").isNull()), ("height_estimated_from_floors", F.col("floor_count").isNotNull()))
    return clean.select(
        "source_id", "building_number", "abbreviation", "name", "floor_count",
        F.round(F.col("floor_count") * floor_height_m, 3).alias("estimated_height_m"),
        F.when(F.col("floor_count").isNotNull(), "floor_count").alias("height_source"),
        F.col("footprint.wgs84").alias("footprint_wgs84"),
        F.col("footprint.metric").alias("footprint_m"),
        (F.col("floor_count").isNotNull() & F.col("footprint").isNotNull()).alias("shade_ready"),
        found.alias("quality_flags"),
    )


def quality_summary(rows: DataFrame) -> DataFrame:
    """(flag, n) over all quality_flags."""
    return rows.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).orderBy("flag")


def counts(rows: DataFrame, kind: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("shade_ready").alias("ready")).select(F.lit(kind).alias("kind"), "total", "ready")


def summary(rows: DataFrame, kind: str, known: tuple[str, ...]) -> DataFrame:
    """One row: kind_total, kind_ready and kind_flags, a map from each known flag that occurs to how often; in one pass."""
    flagged = [F.struct(F.lit(flag).alias("key"), F.count_if(F.array_contains("quality_flags", flag)).alias("value")) for flag in known]
    found = F.filter(F.array(*flagged), lambda e: e["value"] > 0)
    return rows.agg(F.count(F.lit(1)).alias(f"{kind}_total"), F.count_if("shade_ready").alias(f"{kind}_ready"), F.map_from_entries(found).alias(f"{kind}_flags"))


def envelope(trees: DataFrame, buildings: DataFrame, generated_at: Column, bbox: tuple[float, float, float, float], source: tuple[str, str], layers: dict[str, tuple[int, str]]) -> DataFrame:
    """One row that says where a data set comes from, what was assumed, and what is in it; generated_at is a UTC instant, source a name and an address, layers have an id and a name."""
    west, south, east, north = bbox
    named = [x for kind, (number, name) in layers.items() for x in (F.lit(kind), F.struct(F.lit(number).alias("id"), F.lit(name).alias("name")))]
    counted = summary(trees, "trees", TREE_FLAGS).crossJoin(summary(buildings, "buildings", BUILDING_FLAGS))
    return counted.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat(F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("generated_at"),
        F.lit(source[0]).alias("source_name"),
        F.lit(source[1]).alias("service_url"),
        F.create_map(*named).alias("layers"),
        F.lit("EPSG:4326").alias("source_crs"),
        F.lit("EPSG:32614").alias("target_crs"),
        F.lit(f"{west},{south},{east},{north}").alias("bbox"),
        F.lit("feet").alias("tree_dimension_source_unit"),
        F.lit(UNIT_STATUS).alias("tree_dimension_unit_status"),
        F.lit(FEET).alias("feet_to_metres"),
        F.lit(FLOOR_M).alias("floor_height_m"),
        *counted.columns,
    )
