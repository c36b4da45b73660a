"""Queries on instants and the sun."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import solar
from penumbra.plans.tables import table
from penumbra.registry import query

BUCKET = "date_trunc('hour', ts) + INTERVAL (extract('minute' FROM ts) // 15 * 15) MINUTE"


def solar_sql(source: str, ts: str = "ts", keep: str = "*") -> str:
    """CTEs that end in `solar`, with the columns of source and the sun's, for the default site."""
    return f"""
sun1 AS (SELECT *, extract('hour' FROM {ts}) + extract('minute' FROM {ts}) / 60e0 + (extract('second' FROM {ts}) + (extract('microsecond' FROM {ts}) % 1000000) / 1e6) / 3600e0 AS h,
  CASE WHEN dayofyear(make_date(CAST(year({ts}) AS BIGINT), 12, 31)) = 366 THEN 366e0 ELSE 365e0 END AS days FROM {source}),
sun2 AS (SELECT *, 2 * pi() / days * (dayofyear({ts}) - 1 + (h - 12) / 24e0) AS g FROM sun1),
sun3 AS (SELECT *, 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) AS eqt,
  0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g) + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.00148e0 * sin(3 * g) AS decl FROM sun2),
sun4 AS (SELECT *, 60 * h + eqt + 4 * -96.3408e0 AS t0, radians(30.6214e0) AS phi FROM sun3),
sun5 AS (SELECT *, radians((t0 - 1440 * floor(t0 / 1440)) / 4 - 180) AS ha FROM sun4),
sun6 AS (SELECT *, 90 - degrees(acos(least(1e0, greatest(-1e0, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha))))) AS alt,
  degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(decl) * cos(phi))) + 180 AS az0 FROM sun5),
sun7 AS (SELECT *, az0 - 360 * floor(az0 / 360) AS az, tan(radians(alt)) AS ta FROM sun6),
sun8 AS (SELECT *, alt + CASE WHEN alt > 85 THEN 0e0 WHEN alt > 5 THEN 58.1e0 / ta - 0.07e0 / ta ** 3 + 0.000086e0 / ta ** 5
  WHEN alt > -0.575 THEN 1735 - 518.2e0 * alt + 103.4e0 * alt ** 2 - 12.79e0 * alt ** 3 + 0.711e0 * alt ** 4 ELSE -20.774e0 / ta END / 3600 AS app FROM sun7),
solar AS (SELECT {keep}, round(alt, 5) AS altitude, round(app, 5) AS apparent_altitude, round(az, 5) AS azimuth, app > 0 AS daylight,
  CASE WHEN app > 0 THEN round(az + 180 - 360 * floor((az + 180) / 360), 5) END AS shadow_azimuth FROM sun8)"""


BUCKETS = f"buckets AS (SELECT {BUCKET} AS bucket_start, count(*) AS n_events FROM events GROUP BY 1)"


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(solar.time_bucket(F.col("ts")).alias("bucket_start")).agg(F.count(F.lit(1)).alias("n_events"))


@query("time_bucket", f"SELECT event_id, {BUCKET} AS bucket_start FROM events")
def time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", solar.time_bucket(F.col("ts")).alias("bucket_start"))


@query("solar_position", f"WITH {BUCKETS}, {solar_sql('buckets', 'bucket_start', 'bucket_start, n_events')} SELECT * FROM solar")
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sun at the start of each bucket with events: counted first, so the trigonometry runs once a bucket."""
    return solar.with_solar(buckets(spark, sf_dir), "bucket_start")


@query("solar_instant", f"WITH {solar_sql('events', 'ts', 'event_id')} SELECT event_id, altitude, azimuth, daylight FROM solar")
def solar_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sun at each event's exact instant."""
    return solar.with_solar(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").select("event_id", "altitude", "azimuth", "daylight")


_A = "(event_id % 2200) / 11e0 - 100"


@query(
    "refraction",
    f"""WITH a AS (SELECT event_id, {_A} + 1e-1 AS a FROM events), t AS (SELECT *, tan(radians(a)) AS t FROM a)
SELECT event_id, round(CASE WHEN a > 85 THEN 0e0 WHEN a > 5 THEN 58.1e0 / t - 0.07e0 / t ** 3 + 0.000086e0 / t ** 5
  WHEN a > -0.575 THEN 1735 - 518.2e0 * a + 103.4e0 * a ** 2 - 12.79e0 * a ** 3 + 0.711e0 * a ** 4 ELSE -20.774e0 / t END / 3600, 8) AS degrees FROM t""",
)
def refraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("event_id") % 2200) / F.lit(11.0) - 100 + 0.1
    return table(spark, sf_dir, "events").select("event_id", F.round(solar.refraction(a), 8).alias("degrees"))


_TEXT = "concat(CAST(CAST(o_orderdate AS DATE) AS STRING), CASE o_orderkey % 5 WHEN 0 THEN 'T10:00:00Z' WHEN 1 THEN 'T10:00:00-05:00' WHEN 2 THEN 'T10:00:00' WHEN 3 THEN 'T25:00:00Z' ELSE '' END)"


@query("time_validate", f"WITH t AS (SELECT o_orderkey, {_TEXT} AS text FROM orders) SELECT o_orderkey, coalesce(regexp_full_match(text[20:], 'Z|[+-][0-9][0-9]:?[0-9][0-9]') AND TRY_CAST(replace(text[1:19], 'T', ' ') AS TIMESTAMP) BETWEEN TIMESTAMP '1800-01-01' AND TIMESTAMP '2100-12-31', false) AS valid FROM t")
def time_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TEXT).alias("text"))
    return texts.select("o_orderkey", solar.valid_instant(F.col("text")).alias("valid"))
