"""Scalar expressions of the travel-time engine, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The city's origin and metres of a degree of latitude.
LAT0, LON0, DEGREE = 49.84, 24.03, 111320.0


def to_x(lon: Column) -> Column:
    import math

    return (lon - LON0) * DEGREE * math.cos(math.radians(LAT0))


def to_y(lat: Column) -> Column:
    return (lat - LAT0) * DEGREE


def hms(text: Column) -> Column:
    """Service-day seconds of HH:MM:SS, where hours may exceed 24."""
    p = F.split(text, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def vehicle_type(short: Column) -> Column:
    return F.when(short.startswith("Тр"), "trolleybus").when(short.startswith("Т"), "tram").otherwise("bus")


def decay(age: Column, tau: float) -> Column:
    return F.exp(-F.least(age / tau, F.lit(700.0)))


def lateness(seconds: Column) -> Column:
    """Wrapped to twelve hours either way."""
    return F.pmod(seconds + 43200, F.lit(86400)) - 43200


def flags(*bits: Column) -> Column:
    out = F.lit(0)
    for k, b in enumerate(bits):
        out = out + F.when(b, 1 << k).otherwise(0)
    return out


def natural(short: Column) -> tuple[Column, Column]:
    """Sort key of a route name: its digits as a number (0 without any), then the text."""
    return F.coalesce(F.nullif(F.regexp_replace(short, "[^0-9]", ""), F.lit("")).cast("long"), F.lit(0).cast("long")), short


def to_latlon(x: Column, y: Column) -> tuple[Column, Column]:
    """Back from metres about the origin."""
    import math

    return y / DEGREE + LAT0, x / (DEGREE * math.cos(math.radians(LAT0))) + LON0


def ground_metres(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane, with the cosine of the mean latitude."""
    return F.hypot((lat - lat2) * DEGREE, (lon - lon2) * DEGREE * F.cos(F.radians((lat + lat2) / 2)))


def sphere_metres(lat: Column, lon: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    h = F.pow(F.sin(F.radians(lat - lat2) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon - lon2) / 2), 2)
    return F.asin(F.sqrt(h)) * 2 * radius


def to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The clamped fraction along a segment that is nearest to a point, and the squared distance there."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    f = F.when(length == 0, 0.0).otherwise(F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / length, F.lit(0.0)), F.lit(1.0)))
    return f, F.pow(x - (ax + f * dx), 2) + F.pow(y - (ay + f * dy), 2)


def nearest_day(secs: Column, midnight: Column, now: Column) -> Column:
    """The instant of yesterday's, today's or tomorrow's service day that is nearest to now."""
    days = F.array(*(F.struct(F.abs(midnight + secs + k * 86400 - now).alias("gap"), (midnight + secs + k * 86400).alias("at")) for k in (-1, 0, 1)))
    return F.array_min(days)["at"]


def hill(rise: Column, run: Column) -> Column:
    """How much of the level pace is left on a slope of three tenths at most."""
    slope = F.least(F.greatest(rise / run, F.lit(-0.3)), F.lit(0.3))
    return F.exp((F.abs(slope + 0.05) - 0.05) * -3.5)


def heading(dx: Column, dy: Column) -> Column:
    """Whole degrees clockwise from north."""
    return F.round(F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))).cast("long") % 360


def poll_wait(period: Column, fails: Column) -> Column:
    """Twice as long after each failure, two minutes at most."""
    return F.greatest(F.least(period * F.pow(F.lit(2.0), fails), F.lit(120.0)), F.lit(0.5))


def worth_logging(fails: Column) -> Column:
    return fails.isin(1, 5) | ((fails > 0) & (fails % 50 == 0))
