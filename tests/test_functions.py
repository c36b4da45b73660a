"""Known values of the scalar functions and of geometry."""

import math

import pytest
from pyspark.sql import functions as F

from penumbra.functions import geo, solar, text
from penumbra.operators import ingest, shade, shadows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "at, altitude, azimuth",
    [("2026-06-21 12:00:00", 6.26498, 66.42480), ("2026-06-21 18:00:00", 80.59973, 138.22519), ("2026-06-22 00:00:00", 17.24100, 287.46865), ("2026-06-22 06:00:00", -35.54974, 352.28348)],
)
def test_sun_against_published_positions(spark, at, altitude, azimuth):
    df = spark.createDataFrame([(at,)], "at string").select(F.col("at").cast("timestamp_ntz").alias("ts"))
    row = solar.with_solar(df, "ts").first()
    assert row.altitude == pytest.approx(altitude, abs=0.55) and row.azimuth == pytest.approx(azimuth, abs=0.55)
    assert (row.shadow_azimuth is None) == (altitude < 0) and row.daylight == (altitude > 0)


def test_bucket(spark):
    row = one(spark, solar.time_bucket(F.lit("2026-08-30 15:23:59.5").cast("timestamp_ntz")).cast("string").alias("b"))
    assert row.b == "2026-08-30 15:15:00"
    with pytest.raises(ValueError):
        solar.time_bucket(F.lit(0), 7)


def test_instants_need_an_offset(spark):
    cases = {"2026-09-02T13:15:00-05:00": True, "2026-09-02T13:15:00Z": True, "2026-09-02T13:15:00": False, "1700-01-01T00:00:00Z": False, "soon": False, None: False}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", solar.valid_instant(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == cases


def test_utm(spark):
    m = geo.utm14(F.col("lon"), F.col("lat"))
    df = spark.createDataFrame([(-99.0, 0.0), (-96.330805123295079, 30.622790451569642), (0.0, 89.0)], "lon double, lat double").select(m.alias("m"))
    a, b, c = (r.m for r in df.collect())
    assert (round(a.x, 3), round(a.y, 3)) == (500000.0, 0.0)
    assert b.x == pytest.approx(755859.875963, abs=1e-3) and b.y == pytest.approx(3390836.050557, abs=1e-3)
    assert c is None


def test_text(spark):
    df = spark.createDataFrame([(" 8.0 ",), ("1d",), ("",), (None,), ("-3",), ("inf",), ("nan",), ("201",), ("7.5",)], "t string")
    rows = df.select(text.clean_text(F.col("t")).alias("c"), text.positive_number(F.col("t")).alias("n"), text.positive_integer(F.col("t")).alias("i")).collect()
    assert [r.n for r in rows] == [8.0, None, None, None, None, math.inf, None, 201.0, 7.5]
    assert [r.i for r in rows] == [8, None, None, None, None, None, None, None, None]
    assert rows[2].c is None
    r = one(spark, text.slug(F.lit(" Straße & Évans (2) ")).alias("s"), text.format_distance(F.lit(1250)).alias("d"), text.format_distance(F.lit(999)).alias("m"), text.format_duration(F.lit(10)).alias("t"))
    assert (r.s, r.d, r.m, r.t) == ("strasse-évans-2", "1.3 km", "999 m", "1 min")


def test_errors(spark):
    r = one(spark, geo.bearing_error(F.lit(358.0), F.lit(2.0)).alias("a"), geo.bearing_error(F.lit(10.0), F.lit(350.0)).alias("b"), geo.percent_error(F.lit(0.0), F.lit(4.0)).alias("c"), geo.percent_error(F.lit(100.0), F.lit(90.0)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (4.0, 20.0, None, 10.0)


def ring(*points):
    return F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in points])


SQUARE = ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))


def test_capsule(spark):
    p = one(spark, geo.capsule(geo.point(F.lit(0), F.lit(0)), F.lit(2.0), F.lit(10.0), F.lit(90.0)).alias("p"), geo.capsule(geo.point(F.lit(0), F.lit(0)), F.lit(2.0), F.lit(0.0), F.lit(90.0)).alias("c"))
    xs, ys = [q.x for q in p.p], [q.y for q in p.p]
    assert len(xs) == 19 and p.p[0] == p.p[-1] and (min(xs), max(xs), min(ys), max(ys)) == (-2, 12, -2, 2)
    assert len(p.c) == 17
    with pytest.raises(ValueError):
        geo.capsule(F.lit(0), F.lit(0), F.lit(0), F.lit(0), 9)


def test_ring_measures(spark):
    r = one(spark, geo.ring_area_twice(ring(*SQUARE)).alias("a"), geo.ring_centroid(ring(*SQUARE)).alias("c"), geo.ring_centroid(ring((0, 0), (2, 2), (0, 0))).alias("d"), geo.footprint_center(F.array(ring((0, 0), (1, 0), (1, 1), (0, 0)), ring(*SQUARE))).alias("f"))
    assert r.a == 200 and (r.c.x, r.c.y) == (5, 5) and r.d.x == pytest.approx(2 / 3) and (r.f.x, r.f.y) == (5, 5)


def test_map_points(spark):
    center = geo.point(F.lit(100), F.lit(200))
    p = one(spark, geo.metric_to_wgs84(ring((100, 200), (200, 300), (100, 200)), center, F.lit(-96.34), F.lit(30.62)).alias("p")).p
    assert (p[0].x, p[0].y) == (-96.34, 30.62) and p[1].x > p[0].x and p[1].y > p[0].y and p[0] == p[2]


def test_overlap_counts_once(spark):
    spans = spark.createDataFrame([(1, 0.0, 0.4), (1, 0.2, 0.7), (2, 0.0, 0.4), (2, 0.2, 0.7), (2, 0.9, 1.0)], "k int, t0 double, t1 double")
    assert {r.k: round(r.fraction, 9) for r in shade.covered(spans, ["k"]).collect()} == {1: 0.7, 2: 0.8}


def test_line_through_rings(spark):
    hole = ring((3, 3), (7, 3), (7, 7), (3, 7), (3, 3))
    sides = F.concat(geo.sides(ring(*SQUARE)), geo.sides(hole))
    r = one(spark, geo.spans_inside(sides, F.lit(-5.0), F.lit(5.0), F.lit(15.0), F.lit(5.0)).alias("s"), geo.spans_inside(sides, F.lit(-5.0), F.lit(20.0), F.lit(15.0), F.lit(20.0)).alias("none"), geo.spans_inside(sides, F.lit(4.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("in_hole"))
    assert [(round(s.t0, 9), round(s.t1, 9)) for s in r.s] == [(0.25, 0.4), (0.6, 0.75)] and r.none == [] and r.in_hole == []


def sweep_area(spark, rings, length, azimuth):
    """The area of a swept footprint, from the spans that its pieces cover on many lines."""
    reach = length
    sun = spark.createDataFrame([("x", 45.0, float(azimuth), True)], "bucket_start string, apparent_altitude double, shadow_azimuth double, daylight boolean")
    b = spark.range(1).select(F.lit(1).alias("source_id"), F.lit(float(reach)).alias("height_m"), F.array(*[ring(*r) for r in rings]).alias("footprint_m"))
    pieces = shadows.building_pieces(b, sun)
    n, low, high = 400, -1.0, 13.0
    rows = spark.range(n).select(F.col("id").alias("line"), (F.lit(low) + (F.col("id") + 0.5) * ((high - low) / n)).alias("y"))
    met = rows.crossJoin(pieces).select("line", F.explode(geo.spans_inside(F.col("sides"), F.lit(-20.0), F.col("y"), F.lit(30.0), F.col("y"))).alias("s")).select("line", "s.t0", "s.t1")
    return shade.covered(met, ["line"]).agg(F.sum("fraction")).first()[0] * 50 * (high - low) / n


def test_sweeps(spark):
    assert sweep_area(spark, [((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))], 3, 90) == pytest.approx(10, abs=0.2)
    court = ((3, 3), (7, 3), (7, 7), (3, 7), (3, 3))
    assert sweep_area(spark, [SQUARE, court], 2, 90) == pytest.approx(112, abs=1.0)


def test_ring_topology(spark):
    rings = [SQUARE, ((2, 2), (4, 2), (4, 4), (2, 4), (2, 2)), ((20, 0), (22, 0), (22, 2), (20, 2), (20, 0))]
    df = spark.range(1).select(F.lit(1).alias("id"), F.posexplode(F.array(*[ring(*r) for r in rings])).alias("ring", "points"))
    got = {r.ring: (r.depth, r.hole, r.shell) for r in shadows.ring_depths(df).collect()}
    assert got == {0: (0, False, None), 1: (1, True, 0), 2: (0, False, None)}


def test_valid_rings(spark):
    bad = [ring((0, 0), (1, 1), (0, 0)), ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((0, 0), (1, 1), (2, 2), (0, 0))]
    r = one(spark, *[shadows.valid_ring(b).alias(f"b{i}") for i, b in enumerate(bad)], shadows.valid_ring(ring(*SQUARE)).alias("good"))
    assert (r.b0, r.b1, r.b2, r.good) == (False, False, False, True)


def test_normalised_trees(spark):
    schema = "objectid long, common_name string, species string, height string, canopy_spread string, health string, status string, date_removed long, x double, y double"
    rows = [(1, "Oak", None, "40", "20", "Good", "Alive", None, -96.3408, 30.6214), (2, None, None, None, "0", "Dead", "Dead", None, -96.3407, 30.6213), (3, None, None, "30", "16", None, None, 0, -96.3406, 30.6212)]
    a, b, c = ingest.normalize_trees(spark.createDataFrame(rows, schema)).orderBy("source_id").collect()
    assert (a.height_m, a.canopy_diameter_m, a.canopy_radius_m, a.shade_ready, a.quality_flags) == (12.192, 6.096, 3.048, True, [])
    assert b.quality_flags == ["missing_height", "missing_canopy_spread", "dead"] and not b.shade_ready
    assert c.quality_flags == ["health_unknown", "status_unknown", "removed"] and not c.shade_ready
    assert shadows.eligible_trees(ingest.normalize_trees(spark.createDataFrame(rows, schema))).count() == 1


def test_places_off_the_globe(spark):
    import pytest
    from pyspark.sql import functions as F

    from penumbra.functions.solar import with_solar

    df = spark.createDataFrame([(30.0, -96.0), (91.0, 0.0), (0.0, 180.5), (None, 1.0)], "lat double, lon double").withColumn("at", F.lit("2026-06-21 18:00:00").cast("timestamp_ntz"))
    got = with_solar(df, "at", F.col("lat"), F.col("lon")).collect()
    assert got[0].daylight and all(r.altitude is None and r.daylight is None for r in got[1:])
    for place in ((91, 0), (0, -181), (float("nan"), 0)):
        with pytest.raises(ValueError, match="must be between"):
            with_solar(df, "at", *place)
