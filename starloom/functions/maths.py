"""Arithmetic helpers that agree over engines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds half up by floor(x * 10**digits + 0.5)."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    scale = 10.0**digits
    return F.rint(x * scale) / scale


def steady(x: Column, digits: int) -> Column:
    """Cut to so many digits at a place that short decimal fractions never meet, so that the last bit of x can't decide."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.3137) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rev(x: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(F.pmod(x, F.lit(360.0)), F.lit(360.0))


def sind(x: Column) -> Column:
    return F.sin(x * (math.pi / 180))


def cosd(x: Column) -> Column:
    return F.cos(x * (math.pi / 180))


def asind(x: Column) -> Column:
    return F.asin(clamp(x, -1.0, 1.0)) * (180 / math.pi)


def atan2d(y: Column, x: Column) -> Column:
    return F.atan2(y, x) * (180 / math.pi)
