"""Scalar functions as column expressions, and the same as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0
KERNELS = ("exp", "gauss", "power")


def merc_x(lon: Column) -> Column:
    """Web Mercator easting in metres of a longitude in degrees."""
    return F.radians(lon) * EARTH_RADIUS_M


def merc_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(lat) / 2)) * EARTH_RADIUS_M


def merc_lon(x: Column) -> Column:
    return F.degrees(x / EARTH_RADIUS_M)


def merc_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / EARTH_RADIUS_M)) * 2 - 3.141592653589793 / 2)


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def kernel(d: Column, scale: Column | float, kind: str = "exp") -> Column:
    """Decay of a distance; an infinite distance gives 0 for every kind."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    if kind == "exp":
        value = F.exp(-d / s)
    elif kind == "gauss":
        value = F.exp(-(d * d) / (F.lit(2.0) * s * s))
    elif kind == "power":
        value = F.pow(d + 1, -s)
    else:
        raise ValueError(f"unknown kernel {kind!r}; one of {KERNELS}")
    return F.when(d == float("inf"), F.lit(0.0)).otherwise(value)


def masked_power(x: Column, exponent: float) -> Column:
    """x to the exponent where x is positive, else 0 (also for null and NaN)."""
    return F.when(finite(x) & (x > 0), F.pow(x, F.lit(float(exponent)))).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of doubles, value for value, where there are many: only large numbers and those near a tie go by way of decimals."""
    up = x * 10.0**digits
    near = F.rint(up) + 0.0  # no negative zero
    sure = (F.abs(up) < 1e9) & (F.abs(up - near) < 0.5 - 1e-4)
    return F.when(sure, near / 10.0**digits).otherwise(F.round(x, digits))


def contains(text: Column, keyword: str) -> Column:
    """Case-insensitive regular expression search for any script; a null does not match."""
    return F.coalesce(text.rlike("(?iu)" + keyword), F.lit(False))


def whole_number(text: Column) -> Column:
    """Counts as people write them: spaces and commas go, anything but an integer is null."""
    bare = F.regexp_replace(text, "[ ,]", "")
    return F.when(bare.rlike("^[+-]?[0-9]+$"), bare.try_cast("bigint"))


def register(spark: SparkSession) -> None:
    """SQL functions merc_x, merc_y, merc_lon, merc_lat and decay_kernel."""
    for name, args, body in (
        ("merc_x", "lon DOUBLE", "radians(lon) * 6378137.0"),
        ("merc_y", "lat DOUBLE", "ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0"),
        ("merc_lon", "x DOUBLE", "degrees(x / 6378137.0)"),
        ("merc_lat", "y DOUBLE", "degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2)"),
        (
            "decay_kernel",
            "d DOUBLE, scale DOUBLE, kind STRING",
            """CASE WHEN kind NOT IN ('exp', 'gauss', 'power') THEN CAST(raise_error(concat('unknown kernel ', kind)) AS DOUBLE)
                    WHEN d = double('Infinity') THEN 0D WHEN kind = 'exp' THEN exp(-d / scale)
                    WHEN kind = 'gauss' THEN exp(-d * d / (2 * scale * scale)) ELSE power(d + 1, -scale) END""",
        ),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
