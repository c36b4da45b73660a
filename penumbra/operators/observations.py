"""Field observations: checks in a fixed order, errors of predictions, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from penumbra.functions.geo import bearing_error, percent_error

TYPES, OBJECTS, PREFERENCES, CLOUDS = ("route", "shadow"), ("building", "tree"), ("fastest", "shadiest"), ("clear", "overcast", "partly_cloudy")


def checks(kinds: bool = False) -> list[tuple[Column, str]]:
    """(when it applies, what is then said) in the order in which an observation is looked at; the first that applies is reported. The messages are fixed values.

    Columns are typed. With kinds, a column that says what a document holds at each path, absent values, values of another type and what should be an object are told
    apart; without it, a null is an absent value.
    """
    c = F.col

    def absent(name: str, field: str) -> Column:
        return c("kinds")[field].isNull() if kinds else c(name).isNull()

    def within(field: str) -> list[tuple[Column, str]]:
        return [(c("kinds")[field].isNull(), f"{field} is required"), (c("kinds")[field] != "object", f"{field} must be an object")] if kinds else []

    def text(name: str, field: str) -> list[tuple[Column, str]]:
        return [(absent(name, field), f"{field} is required"), (c(name).isNull() | (F.btrim(name) == ""), f"{field} must be a non-empty string")]

    def one_of(name: str, field: str, values: tuple[str, ...]) -> list[tuple[Column, str]]:
        return [*text(name, field), (~F.btrim(name).isin(*values), f"{field} must be one of {list(values)}")]

    def number(name: str, field: str, least: int, most: int | None = None) -> list[tuple[Column, str]]:
        found = [(absent(name, field), f"{field} is required"), (c(name).isNull() | F.isnan(name), f"{field} must be a number"), (c(name) < least, f"{field} must be at least {least}")]
        return found if most is None else [*found, (c(name) > most, f"{field} must be at most {most}")]

    def only(kind: str, *rules: list[tuple[Column, str]]) -> list[tuple[Column, str]]:
        return [((c("observation_type") == kind) & bad, said) for rule in rules for bad, said in rule]

    out = [
        *text("observed_at", "observed_at"),
        (F.try_to_timestamp(c("observed_at")).isNull(), "observed_at must be ISO 8601"),
        (~c("observed_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), "observed_at must include a timezone offset"),
        *one_of("observation_type", "observation_type", TYPES),
        *within("location"),
        *number("latitude", "location.latitude", -90, 90),
        *number("longitude", "location.longitude", -180, 180),
        *number("gps_accuracy_m", "location.gps_accuracy_m", 0),
        *within("conditions"),
        *one_of("cloud_condition", "conditions.cloud_condition", CLOUDS),
        *within("evidence"),
        (absent("photos", "evidence.photo_files"), "evidence.photo_files is required"),
        (c("photos") == 0, "evidence.photo_files must contain at least one filename"),
        *only("shadow", within("subject"), one_of("object_type", "subject.object_type", OBJECTS), text("source_feature_id", "subject.source_feature_id")),
        *only("route", within("route"), text("origin_id", "route.origin_id"), text("destination_id", "route.destination_id"), one_of("preference", "route.preference", PREFERENCES)),
    ]
    for side in ("observed", "predicted"):
        out += only("shadow", within(side), number(f"{side}_bearing", f"{side}.shadow_bearing_degrees", 0, 360), number(f"{side}_length", f"{side}.shadow_length_m", 0), number(f"{side}_fraction", f"{side}.walkway_shade_fraction", 0, 1))
        out += only("route", within(side), number(f"{side}_distance", f"{side}.distance_m", 0), number(f"{side}_duration", f"{side}.duration_seconds", 0), number(f"{side}_fraction", f"{side}.shade_fraction", 0, 1))
    return out


def violations(observations: DataFrame) -> DataFrame:
    """observation_id, pos, message: what is first wrong with each observation that isn't right; a repeated id is looked for last, an absent one first."""
    number = F.col("observation_id")
    path = F.concat(F.lit("observation["), F.btrim(number), F.lit("]."))
    kinds = "kinds" in observations.columns
    unnamed = F.when(F.col("kinds")[""] != "object", "each observation must be an object") if kinds else F
    unnamed = unnamed.when(F.col("kinds")["observation_id"].isNull() if kinds else number.isNull(), "observation.observation_id is required").when(number.isNull() | (F.btrim(number) == ""), "observation.observation_id must be a non-empty string")
    # rows without an id aren't compared with one another
    salt = F.when(number.isNull(), F.col("pos"))
    nth = F.row_number().over(W.partitionBy("observation_id", salt).orderBy("pos"))
    repeated = F.when(F.col("nth") > 1, F.concat(F.lit("duplicate observation_id: "), number))
    message = F.coalesce(unnamed, *[F.when(bad, F.concat(path, F.lit(said))) for bad, said in checks(kinds)], repeated)
    return observations.withColumn("nth", nth).select("observation_id", "pos", message.alias("message")).filter("message is not null")


def valid(observations: DataFrame) -> DataFrame:
    return observations.join(violations(observations).select("pos"), "pos", "left_anti")


def shadow_errors(observations: DataFrame) -> DataFrame:
    """Errors of predicted shadows, each rounded to 3 places."""
    o = observations.filter("observation_type = 'shadow'")
    apart = lambda name: F.abs(F.col(f"predicted_{name}") - F.col(f"observed_{name}"))
    return o.select(
        "observation_id", "pos", "object_type",
        F.round(bearing_error(F.col("observed_bearing"), F.col("predicted_bearing")), 3).alias("bearing_error_degrees"),
        F.round(apart("length"), 3).alias("length_error_m"),
        F.round(percent_error(F.col("observed_length"), F.col("predicted_length")), 3).alias("length_error_percent"),
        F.round(apart("fraction") * 100, 3).alias("walkway_shade_error_percentage_points"),
    )


def route_errors(observations: DataFrame) -> DataFrame:
    """Errors of predicted routes, each rounded to 3 places."""
    o = observations.filter("observation_type = 'route'")
    apart = lambda name: F.abs(F.col(f"predicted_{name}") - F.col(f"observed_{name}"))
    return o.select(
        "observation_id", "pos", "preference",
        F.round(apart("distance"), 3).alias("distance_error_m"),
        F.round(percent_error(F.col("observed_distance"), F.col("predicted_distance")), 3).alias("distance_error_percent"),
        F.round(apart("duration"), 3).alias("duration_error_seconds"),
        F.round(percent_error(F.col("observed_duration"), F.col("predicted_duration")), 3).alias("duration_error_percent"),
        F.round(apart("fraction") * 100, 3).alias("shade_error_percentage_points"),
    )


def means(errors: DataFrame, digits: int = 3) -> DataFrame:
    """One row: count, and the mean of each error (nulls left out, null if there is none)."""
    measures = [c for c in errors.columns if "_error_" in c]
    return errors.agg(F.count(F.lit(1)).alias("count"), *[F.round(F.avg(c), digits).alias(f"mean_absolute_{c}") for c in measures])


def report(observations: DataFrame) -> DataFrame:
    """One row: schema_version, observation_count, shadow_summary, route_summary; for write_document. Errors of single observations stay rows of their own."""
    s = means(shadow_errors(observations)).select(F.struct("*").alias("shadow_summary"))
    r = means(route_errors(observations)).select(F.struct("*").alias("route_summary"))
    n = F.col("shadow_summary.count") + F.col("route_summary.count")
    return s.crossJoin(r).select(F.lit("1.0").alias("schema_version"), n.alias("observation_count"), "shadow_summary", "route_summary")


def report_pieces(observations: DataFrame) -> DataFrame:
    """section, pos, text: the whole report as pieces of one JSON document, in order by section and pos; for documents.write_pieces.

    It begins as report() does; then come the errors of each shadow and of each route, one row a piece, in the order of pos, nulls said. No list is ever built.
    """
    head = F.regexp_replace(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), r"\}$", ',"shadow_observations":[')
    fixed = report(observations).select(F.explode(F.array(*[F.struct(F.lit(n).alias("section"), t.alias("text")) for n, t in ((0, head), (2, F.lit('],"route_observations":[')), (4, F.lit("]}")))])).alias("f"))
    pieces = fixed.select("f.section", F.lit(0).cast("long").alias("pos"), "f.text")
    for section, errors in ((1, shadow_errors(observations)), (3, route_errors(observations))):
        first = F.broadcast(errors.agg(F.min("pos").alias("first")))
        row = F.to_json(F.struct(*[c for c in errors.columns if c != "pos"]), {"ignoreNullFields": "false"})
        listed = errors.crossJoin(first).select(F.lit(section).alias("section"), F.col("pos").cast("long").alias("pos"), F.concat(F.when(F.col("pos") == F.col("first"), "").otherwise(","), row).alias("text"))
        pieces = pieces.unionByName(listed)
    return pieces
