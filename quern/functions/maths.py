"""Numeric functions that Spark lacks or defines otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Euclid's algorithm on 64-bit integers ends after at most this many divisions.
EUCLID_STEPS = 92


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, not negative; gcd(0, 0) is 0; null if either is."""
    pair = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % F.nullif(p["y"], F.lit(0))).alias("y")))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(EUCLID_STEPS)), pair, step, lambda p: p["x"])
    return F.when(a.isNotNull() & b.isNotNull(), done)


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple, not negative; 0 if either is 0."""
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") / g * b).cast("long"))


def _exact(x: Column, table: dict[int, float], period: int, inner: Column) -> Column:
    """inner, but for whole multiples of 30 or 45 degrees, whose values are exact."""
    turn = F.pmod(x, F.lit(float(period)))
    return reduce(lambda out, kv: F.when(turn == kv[0], F.lit(kv[1])).otherwise(out), table.items(), inner)


def sind(x: Column) -> Column:
    return _exact(x, {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}, 360, F.sin(F.radians(x)))


def cosd(x: Column) -> Column:
    return _exact(x, {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5}, 360, F.cos(F.radians(x)))


def tand(x: Column) -> Column:
    return _exact(x, {0: 0.0, 45: 1.0, 90: float("inf"), 135: -1.0}, 180, F.tan(F.radians(x)))


def cotd(x: Column) -> Column:
    return _exact(x, {0: float("inf"), 45: 1.0, 90: 0.0, 135: -1.0}, 180, F.cot(F.radians(x)))


def asind(x: Column) -> Column:
    return F.when(F.abs(x) == 0.5, F.signum(x) * 30.0).otherwise(F.degrees(F.asin(x)))


def acosd(x: Column) -> Column:
    return F.when(x == 0.5, 60.0).when(x == -0.5, 120.0).otherwise(F.degrees(F.acos(x)))


def atand(x: Column) -> Column:
    return F.when(F.abs(x) == 1, F.signum(x) * 45.0).otherwise(F.degrees(F.atan(x)))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def trunc(x: Column, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def width_bucket(x: Column, low: float, high: float, count: int) -> Column:
    """0 below the range, count + 1 at and above its end."""
    return F.when(x < low, 0).when(x >= high, count + 1).otherwise(F.floor((x - low) * count / (high - low)) + 1).cast("int")


def factorial(n: Column) -> Column:
    return F.factorial(n)


def normal_rand(mean: float, deviation: float, seed: int = 0) -> Column:
    return F.randn(seed) * deviation + mean
