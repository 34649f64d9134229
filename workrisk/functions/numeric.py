"""Numeric building blocks. Null stays null unless a function says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def ramp(c: Column, floor, full) -> Column:
    """0 up to the floor, 1 from full on, a straight line between."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (floor, full))
    line = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(c - low, high - low)))
    return F.when(c.isNotNull(), F.when(high <= low, F.lit(0.0)).otherwise(line))


def ramp_or_zero(c: Column, full: float) -> Column:
    """As ramp() from 0, with 0 for null."""
    return F.coalesce(ramp(c, 0.0, full), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def share_percent(a: Column, b: Column, digits: int = 1) -> Column:
    return F.round(ratio(a, b) * 100, digits)


def is_true(c: Column) -> Column:
    """A condition in which null counts as false."""
    return F.coalesce(c, F.lit(False))


def money_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows; 0 for nothing."""
    return F.coalesce(F.sum(c.cast("decimal(20,2)")), F.lit(0).cast("decimal(20,2)")).cast("double")


def mean_of(c: Column, digits: int, to: int) -> Column:
    """The mean of values of so many digits, rounded half up to ``to`` digits: sums
    and division are of whole numbers, so it doesn't depend on the order of rows."""
    total, n = F.sum(F.round(c * 10**digits).cast("long")), F.count(c)
    step = 10 ** (digits - to)
    return F.when(n > 0, F.floor((2 * total + step * n) / (2 * step * n)) / 10.0**to)


def round_scaled(c: Column, digits: int) -> Column:
    """As SQL engines written in C round: c * 10^digits to the next whole number,
    half away from zero, and back."""
    return F.round(c * float(10**digits), 0) / float(10**digits)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def harmonic(n: int) -> float:
    """Mean depth of an unsuccessful search among n leaves."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0
