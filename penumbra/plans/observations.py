"""Queries on field observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions.geo import bearing_error as bearing
from penumbra.functions.geo import percent_error as percent
from penumbra.operators import observations as ops
from penumbra.plans.tables import OBSERVATIONS, observations
from penumbra.registry import query

_PATH = "'observation[' || trim(observation_id) || '].' || "


def _said(*rules: tuple[str, str]) -> str:
    return " ".join(f"WHEN {bad} THEN {_PATH}'{said}'" for bad, said in rules)


def _number(column: str, field: str, least: int, most: int | None, kind: str = "true") -> str:
    above = [] if most is None else [(f"{kind} AND {column} > {most}", f"{field} must be at most {most}")]
    return _said((f"{kind} AND {column} IS NULL", f"{field} is required"), (f"{kind} AND {column} < {least}", f"{field} must be at least {least}"), *above)


def _text(column: str, field: str, kind: str = "true", values: str = "") -> str:
    among = [(f"{kind} AND trim({column}) NOT IN ({values})", f"{field} must be one of [{values}]".replace("'", "''"))] if values else []
    return _said((f"{kind} AND {column} IS NULL", f"{field} is required"), (f"{kind} AND trim({column}) = ''", f"{field} must be a non-empty string"), *among)


_SHADOW, _ROUTE = "observation_type = 'shadow'", "observation_type = 'route'"
_SIDES = " ".join(
    f"""{_number(f"{side}_bearing", f"{side}.shadow_bearing_degrees", 0, 360, _SHADOW)} {_number(f"{side}_length", f"{side}.shadow_length_m", 0, None, _SHADOW)} {_number(f"{side}_fraction", f"{side}.walkway_shade_fraction", 0, 1, _SHADOW)}
  {_number(f"{side}_distance", f"{side}.distance_m", 0, None, _ROUTE)} {_number(f"{side}_duration", f"{side}.duration_seconds", 0, None, _ROUTE)} {_number(f"{side}_fraction", f"{side}.shade_fraction", 0, 1, _ROUTE)}"""
    for side in ("observed", "predicted")
)
_WRONG = f"""CASE WHEN observation_id IS NULL THEN 'observation.observation_id is required' WHEN trim(observation_id) = '' THEN 'observation.observation_id must be a non-empty string'
  {_text("observed_at", "observed_at")} {_said(("NOT regexp_full_match(observed_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}(Z|[+-][0-9]{2}:[0-9]{2})?')", "observed_at must be ISO 8601"), ("NOT regexp_matches(observed_at, '(Z|[+-][0-9]{2}:[0-9]{2})$')", "observed_at must include a timezone offset"))}
  {_text("observation_type", "observation_type", values="'route', 'shadow'")} {_number("latitude", "location.latitude", -90, 90)} {_number("longitude", "location.longitude", -180, 180)} {_number("gps_accuracy_m", "location.gps_accuracy_m", 0, None)}
  {_text("cloud_condition", "conditions.cloud_condition", values="'clear', 'overcast', 'partly_cloudy'")} {_said(("photos IS NULL", "evidence.photo_files is required"), ("photos = 0", "evidence.photo_files must contain at least one filename"))}
  {_text("object_type", "subject.object_type", _SHADOW, "'building', 'tree'")} {_text("source_feature_id", "subject.source_feature_id", _SHADOW)}
  {_text("origin_id", "route.origin_id", _ROUTE)} {_text("destination_id", "route.destination_id", _ROUTE)} {_text("preference", "route.preference", _ROUTE, "'fastest', 'shadiest'")}
  {_SIDES} WHEN nth > 1 THEN 'duplicate observation_id: ' || observation_id END"""
CHECKED = f"""{OBSERVATIONS}, named AS (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY pos) AS nth FROM obs),
bad AS (SELECT *, {_WRONG} AS message FROM named), good AS (SELECT * FROM bad WHERE message IS NULL)"""
_PERCENT = "CASE WHEN observed_{0} <> 0 THEN round(abs(predicted_{0} - observed_{0}) / observed_{0} * 100, 3) END AS {0}_error_percent"
SHADOW = f"""{CHECKED}, err AS (SELECT *, abs(observed_bearing - predicted_bearing) % 360 AS b, abs(predicted_length - observed_length) AS l, abs(predicted_fraction - observed_fraction) AS f FROM good WHERE observation_type = 'shadow'),
shadow AS (SELECT observation_id, pos, object_type, round(least(b, 360 - b), 3) AS bearing_error_degrees, round(l, 3) AS length_error_m, {_PERCENT.format("length")}, round(f * 100, 3) AS walkway_shade_error_percentage_points FROM err)"""
_ROUTES = f"""route AS (SELECT observation_id, pos, preference, round(abs(predicted_distance - observed_distance), 3) AS distance_error_m, {_PERCENT.format("distance")},
  round(abs(predicted_duration - observed_duration), 3) AS duration_error_seconds, {_PERCENT.format("duration")}, round(abs(predicted_fraction - observed_fraction) * 100, 3) AS shade_error_percentage_points FROM good WHERE observation_type = 'route')"""
ROUTE = f"{CHECKED}, {_ROUTES}"
SHADOW_ERRORS = ("bearing_error_degrees", "length_error_m", "length_error_percent", "walkway_shade_error_percentage_points")
ROUTE_ERRORS = ("distance_error_m", "distance_error_percent", "duration_error_seconds", "duration_error_percent", "shade_error_percentage_points")


def _means(names: tuple[str, ...], before: str = "") -> str:
    return ", ".join([f'count(*) AS "{before}count"', *[f"round(avg({c}), 3) AS {before}mean_absolute_{c}" for c in names]])


@query("bearing_error", f"WITH {OBSERVATIONS}, e AS (SELECT pos, abs(observed_bearing - predicted_bearing) % 360 AS b FROM obs) SELECT pos, least(b, 360 - b) AS degrees FROM e")
def bearing_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("pos", bearing(F.col("observed_bearing"), F.col("predicted_bearing")).alias("degrees"))


@query("percent_error", f"WITH {OBSERVATIONS} SELECT pos, CASE WHEN observed_length <> 0 THEN round(abs(predicted_length - observed_length) / observed_length * 100, 6) END AS percent FROM obs")
def percent_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("pos", F.round(percent(F.col("observed_length"), F.col("predicted_length")), 6).alias("percent"))


@query("obs_violations", f"WITH {CHECKED} SELECT observation_id, pos, message FROM bad WHERE message IS NOT NULL")
def obs_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.violations(observations(spark, sf_dir))


@query("obs_duplicates", f"WITH {OBSERVATIONS} SELECT observation_id, count(*) AS n FROM obs GROUP BY observation_id HAVING count(*) > 1")
def obs_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("observation_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("obs_shadow_errors", f"WITH {SHADOW} SELECT * FROM shadow")
def obs_shadow_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shadow_errors(ops.valid(observations(spark, sf_dir)))


@query("obs_route_errors", f"WITH {ROUTE} SELECT * FROM route")
def obs_route_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.route_errors(ops.valid(observations(spark, sf_dir)))


@query("obs_shadow_summary", f"WITH {SHADOW} SELECT {_means(SHADOW_ERRORS)} FROM shadow")
def obs_shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.means(ops.shadow_errors(ops.valid(observations(spark, sf_dir))))


@query("obs_route_summary", f"WITH {ROUTE} SELECT {_means(ROUTE_ERRORS)} FROM route")
def obs_route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.means(ops.route_errors(ops.valid(observations(spark, sf_dir))))


@query(
    "obs_report",
    f"""WITH {SHADOW}, {_ROUTES}, s AS (SELECT {_means(SHADOW_ERRORS, "shadow_")} FROM shadow), r AS (SELECT {_means(ROUTE_ERRORS, "route_")} FROM route)
  SELECT '1.0' AS schema_version, shadow_count + route_count AS observation_count, s.*, r.* FROM s CROSS JOIN r""",
)
def obs_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's row with its summaries spread over columns."""
    made = ops.report(ops.valid(observations(spark, sf_dir)))
    spread = [F.col(f"{kind}_summary.{c}").alias(f"{kind}_{c}") for kind in ("shadow", "route") for c in made.schema[f"{kind}_summary"].dataType.names]
    return made.select("schema_version", "observation_count", *spread)
