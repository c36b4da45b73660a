"""Position of the sun as a function of time and place, as column expressions.

Fourier series for the equation of time and the declination, then spherical trigonometry and atmospheric refraction. Instants are UTC values without zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default site, in degrees.
LATITUDE, LONGITUDE = 30.6214, -96.3408
#: Coefficients of 1, cos g, sin g, cos 2g, sin 2g, and for the declination cos 3g, sin 3g.
EQUATION_OF_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)


def time_bucket(ts: Column, minutes: int = 15) -> Column:
    """The start of the bucket that an instant lies in; minutes divide an hour."""
    if minutes < 1 or 60 % minutes:
        raise ValueError("minutes must divide 60")
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts) % minutes, F.extract(F.lit("second"), ts))


def valid_instant(text: Column) -> Column:
    """Whether text is an ISO instant with an offset, between the years 1800 and 2100 of UTC."""
    parsed = F.try_to_timestamp(text)
    year = F.year(parsed)
    return F.coalesce(text.rlike(r"(Z|[+-]\d\d:?\d\d)$") & year.between(1800, 2100), F.lit(False))


def series(coefficients: tuple[float, ...], angle: Column) -> Column:
    total = F.lit(coefficients[0])
    for i, c in enumerate(coefficients[1:]):
        wave = (F.cos, F.sin)[i % 2](angle * (i // 2 + 1))
        total = total + F.lit(c) * wave
    return total


def refraction(altitude: Column) -> Column:
    """Degrees by which the air lifts the sun, in four pieces of altitude."""
    t = F.tan(F.radians(altitude))
    low = F.lit(1735.0) - 518.2 * altitude + 103.4 * altitude**2 - 12.79 * altitude**3 + 0.711 * altitude**4
    seconds = F.when(altitude > 85, 0.0).when(altitude > 5, 58.1 / t - 0.07 / t**3 + 0.000086 / t**5).when(altitude > -0.575, low).otherwise(-20.774 / t)
    return seconds / 3600


def with_solar(df: DataFrame, ts: str, latitude: Column | float = LATITUDE, longitude: Column | float = LONGITUDE) -> DataFrame:
    """Adds altitude, apparent_altitude, azimuth, daylight and shadow_azimuth (null at night) for the instant in column ts.

    Angles are degrees to 5 places; daylight is decided before rounding. A fixed place that isn't on the globe is an error; a row whose place isn't gets nulls.
    """
    place = []
    for name, value, most in (("latitude", latitude, 90.0), ("longitude", longitude, 180.0)):
        if isinstance(value, Column):
            place.append(F.when(value.between(-most, most), value))
        elif -most <= float(value) <= most:
            place.append(F.lit(float(value)))
        else:
            raise ValueError(f"{name} must be between {-most:.0f} and {most:.0f} degrees")
    lat, lon = place
    at = F.col(ts)
    own = df.columns
    hour = F.hour(at) + F.minute(at) / 60.0 + F.extract(F.lit("second"), at).cast("double") / 3600.0
    days = F.when(F.dayofyear(F.make_date(F.year(at), F.lit(12), F.lit(31))) == 366, 366.0).otherwise(365.0)
    step = df.withColumn("__h", hour).withColumn("__g", F.lit(2) * F.pi() / days * (F.dayofyear(at) - 1 + (F.col("__h") - 12) / 24))
    step = step.withColumn("__decl", series(DECLINATION, F.col("__g")))
    true_time = F.pmod(60.0 * F.col("__h") + F.lit(229.18) * series(EQUATION_OF_TIME, F.col("__g")) + 4.0 * lon, F.lit(1440.0))
    step = step.withColumn("__angle", F.radians(true_time / 4 - 180)).withColumn("__phi", F.radians(lat))
    phi, decl, angle = F.col("__phi"), F.col("__decl"), F.col("__angle")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle)))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(angle), F.cos(angle) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180, F.lit(360.0))
    step = step.withColumn("__alt", F.when(lat.isNotNull() & lon.isNotNull(), F.lit(90.0) - F.degrees(F.acos(cosine)))).withColumn("__az", azimuth)
    step = step.withColumn("__app", F.col("__alt") + refraction(F.col("__alt")))
    return step.select(
        *[c for c in own if c not in ("altitude", "apparent_altitude", "azimuth", "daylight", "shadow_azimuth")],
        F.round("__alt", 5).alias("altitude"),
        F.round("__app", 5).alias("apparent_altitude"),
        F.round("__az", 5).alias("azimuth"),
        (F.col("__app") > 0).alias("daylight"),
        F.when(F.col("__app") > 0, F.round(F.pmod(F.col("__az") + 180, F.lit(360.0)), 5)).alias("shadow_azimuth"),
    )


def shadow_length(height: Column, apparent_altitude: Column, cap: float = 100.0) -> Column:
    """Metres, at most cap; an altitude of 0 gives the cap, a missing or negative one null."""
    reach = F.try_divide(height, F.tan(F.radians(apparent_altitude)))
    return F.when(apparent_altitude >= 0, F.least(F.coalesce(reach, F.lit(cap)), F.lit(cap)))
