"""Column expressions of the routing library."""

from __future__ import annotations

import math

from collections.abc import Mapping
from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, floors and the Earth's radius that the results rest on.
MPH = 0.44704
LEAST_MPH = 1.0
LEAST_SECONDS = 1e-3
RADIUS_M = 6_371_000.0
KMH_IN_MPH = 0.621371

# Default speed limits (mph) by road class.
DEFAULT_MPH = {
    "motorway": 65,
    "motorway_link": 45,
    "trunk": 55,
    "trunk_link": 40,
    "primary": 45,
    "primary_link": 35,
    "secondary": 35,
    "secondary_link": 30,
    "tertiary": 30,
    "tertiary_link": 25,
    "unclassified": 25,
    "residential": 25,
    "living_street": 15,
    "service": 15,
}
OTHER_MPH = 25


def travel_seconds(length_m: Column, mph: Column) -> Column:
    """Seconds for the length at the speed, which counts as at least 1 mph."""
    return length_m / (F.greatest(mph, F.lit(LEAST_MPH)) * F.lit(MPH))


def bucket_floor(ts: Column, minutes: int = 5) -> Column:
    """The start of the time bucket, counted from midnight."""
    day = F.date_trunc("day", ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (day + F.make_dt_interval(mins=(minute - minute % F.lit(minutes)).cast("int"))).cast("timestamp_ntz")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(a))


def _to_segment(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From the origin of a plane to a segment in it."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(size > 0, size)))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(ax + along * dx, 2) + F.pow(ay + along * dy, 2))


def planar_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a segment, in the equirectangular projection around the point."""
    k = F.lit(RADIUS_M * 3.141592653589793 / 180)
    scale = F.cos(F.radians(lat)) * k
    return _to_segment((lon1 - lon) * scale, (lat1 - lat) * k, (lon2 - lon) * scale, (lat2 - lat) * k)


# The ellipsoid of 1984 and the scale along a zone's central meridian.
ELLIPSOID_A, ELLIPSOID_F, ZONE_SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def mercator_terms() -> tuple[float, float, list[float]]:
    """Of the transverse Mercator projection: the radius of the rectifying sphere, the eccentricity and the factors of the series."""
    n = ELLIPSOID_F / (2 - ELLIPSOID_F)
    radius = ELLIPSOID_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    factors = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    return radius, 2 * math.sqrt(n) / (1 + n), factors


def central_meridian(lon: Column) -> Column:
    """That of the zone, six degrees wide, in which a place lies."""
    return F.least(F.floor((lon + 180) / 6), F.lit(59)) * 6.0 - 177.0


def mercator_xy(lat: Column, lon: Column, central: Column) -> tuple[Column, Column]:
    """Metres east of the central meridian and north of the equator, by the transverse Mercator projection of its zone."""
    radius, e, factors = mercator_terms()
    away = F.radians(F.pmod(lon - central + 540, F.lit(360.0)) - 180)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    north, east = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    y, x = north, east
    for j, factor in enumerate(factors, 1):
        y = y + factor * F.sin(2 * j * north) * F.cosh(2 * j * east)
        x = x + factor * F.cos(2 * j * north) * F.sinh(2 * j * east)
    return ZONE_SCALE * radius * x, ZONE_SCALE * radius * y


def mercator_numpy(lat: np.ndarray, lon: np.ndarray, central: float) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`mercator_xy`, of arrays."""
    radius, e, factors = mercator_terms()
    away, sine = np.radians((lon - central + 540) % 360 - 180), np.sin(np.radians(lat))
    with np.errstate(divide="ignore", over="ignore"):
        t = np.sinh(np.arctanh(sine) - e * np.arctanh(e * sine))
        north, east = np.arctan2(t, np.cos(away)), np.arctanh(np.sin(away) / np.sqrt(1 + t * t))
    y, x = north, east
    for j, factor in enumerate(factors, 1):
        y, x = y + factor * np.sin(2 * j * north) * np.cosh(2 * j * east), x + factor * np.cos(2 * j * north) * np.sinh(2 * j * east)
    return ZONE_SCALE * radius * x, ZONE_SCALE * radius * y


def projected_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a segment, in the transverse Mercator projection of the point's zone."""
    central = central_meridian(lon)
    (x, y), (ax, ay), (bx, by) = (mercator_xy(a, b, central) for a, b in ((lat, lon), (lat1, lon1), (lat2, lon2)))
    return _to_segment(ax - x, ay - y, bx - x, by - y)


def congestion(speed: Column, limit: Column) -> Column:
    """One less the share of the limit that is driven."""
    return 1 - F.try_divide(speed, limit)


def speed_tag_mph(tag: Column) -> Column:
    """The first number of a speed tag in mph; null without one."""
    s = F.lower(F.trim(tag))
    number = F.regexp_extract(s, r"(\d+(?:\.\d+)?)", 1)
    value = F.when(number != "", number.cast("double"))
    return F.when(s.rlike("km/h|kmh|kph"), value * F.lit(KMH_IN_MPH)).otherwise(value)


def road_class(tags: Column) -> Column:
    """The first of the tags, else ``unclassified``."""
    return F.coalesce(F.get(tags, F.lit(0)), F.lit("unclassified"))


def speed_limit_mph(tags: Column, classes: Column, defaults: Mapping[str, int] = DEFAULT_MPH) -> Column:
    """The first tag with a number, else the default of the road class."""
    given = F.get(F.filter(F.transform(tags, speed_tag_mph), lambda x: x.isNotNull()), F.lit(0))
    by_class = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.coalesce(given, F.try_element_at(by_class, road_class(classes)).cast("double"), F.lit(float(OTHER_MPH)))


def lanes(tags: Column) -> Column:
    """The largest number among the tags, whole, else 1."""
    return F.coalesce(F.array_max(F.transform(tags, lambda x: F.floor(x.try_cast("double")).cast("int"))), F.lit(1))


def day_features(ts: Column, holidays: list[str]) -> dict[str, Column]:
    """hour_of_day, day_of_week (Monday 0) and is_holiday."""
    return {"hour_of_day": F.hour(ts), "day_of_week": F.weekday(ts), "is_holiday": F.date_format(ts, "yyyy-MM-dd").isin(holidays)}


def split_of(ts: Column, ranges: Mapping[str, tuple[str, str]]) -> Column:
    """The name of the day range that holds the time, the last one given if several do, else ``unassigned``."""
    day, out = F.to_date(ts), F.lit("unassigned")
    for name, (first, last) in ranges.items():
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(name)).otherwise(out)
    return out


def stratum_of(hour: Column, strata: Mapping[str, tuple[int, int]]) -> Column:
    """The first of the hour ranges [first, past) that holds the hour, else ``other``."""
    out = F.lit("other")
    for name, (first, past) in reversed(strata.items()):
        out = F.when((hour >= first) & (hour < past), F.lit(name)).otherwise(out)
    return out


def blended(bound: Column, learned: Column, weight: Column) -> Column:
    """Between the lower bound and the learned cost to go, which defaults to the bound."""
    return bound + weight * (F.coalesce(learned, bound) - bound)


def guard_ratio(cost: Column, classical: Column) -> Column:
    """Cost over classical cost: one if both are nothing, infinite if only the latter is; null if either is null."""
    return F.when((classical == 0) & (cost == 0), F.lit(1.0)).when((classical == 0) & (cost > 0), F.lit(float("inf"))).otherwise(F.try_divide(cost, classical))


def hashed_digits(*key: Column) -> Column:
    """The SHA-256 of the key's text in hexadecimal digits."""
    return F.sha2(F.concat_ws("|", *key).cast("binary"), 256)


def hashed_unit(*key: Column) -> Column:
    """A number in (0, 1) from the SHA-256 of the key's text."""
    return (F.conv(F.substring(hashed_digits(*key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def first_digits(bound: float) -> str:
    """The digits below which those of :func:`hashed_digits` give a :func:`hashed_unit` below the bound, which is below 1."""
    return format(math.ceil(Fraction(bound) * (1 << 52) - Fraction(1, 2)), "013x")


def hashed_normal(*key: Column) -> Column:
    """A standard normal number from the key, by the Box-Muller transform of two hashed ones."""
    u, v = hashed_unit(*key, F.lit("u")), hashed_unit(*key, F.lit("v"))
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v)


def stars(p: Column) -> Column:
    """Marks of significance; empty for null or NaN."""
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
