"""Numeric expressions whose rounding must be exact."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = int | float


def as_null_if_nan(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def clip(value: Column, low: Number, high: Number) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def ratio_or(numerator: Column, denominator: Column, default: float) -> Column:
    """Division with zero, null and NaN on either side replaced by the default."""
    quotient = as_null_if_nan(numerator) / F.nullif(as_null_if_nan(denominator), F.lit(0.0))
    return F.coalesce(quotient, F.lit(float(default)))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0.0 for an empty whole."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def score_points(probability: Column) -> Column:
    """Probability as points out of 1000, halves to the even neighbour."""
    return F.rint(probability * 1000.0).cast("int")


def _units(probability: Column, digits: int) -> Column:
    """Nearest whole number of 10**-digits to a number in [0, 1], decided on its exact binary value.

    Spark rounds the shortest decimal text of a double, so 0.4125 (its binary value lies just below
    the tie) would go up. Here the product with twice the scale is split in two exact parts to see
    on which side of the tie the value really is; an exact tie goes to the even neighbour.
    """
    scale = float(10**digits)
    low = F.floor(probability * scale)
    spread = probability * 134217729.0  # 2**27 + 1: splits a double into two halves of 26 bits
    head = spread - (spread - probability)
    tail = probability - head
    over_tie = (head * (2 * scale) - (low * 2 + 1)) + tail * (2 * scale)
    up = (over_tie > 0) | ((over_tie == 0) & (low % 2 == 1))
    return low + F.when(up, F.lit(1)).otherwise(F.lit(0))


def round_exact(probability: Column, digits: int) -> Column:
    """A number in [0, 1] to at most six decimals."""
    return _units(probability, digits) / F.lit(float(10**digits))


def three_decimals(probability: Column) -> Column:
    """Text of a number in [0, 1] with three decimals."""
    thousandths = _units(probability, 3)
    return F.format_string("%d.%03d", F.floor(thousandths / 1000), thousandths % 1000)


def edges_passed(edges: Column, value: Column) -> Column:
    """How many of the ascending edges are <= value; null for a null value.

    The test for null also names the value outside the lambda. A value named once would be inlined
    by Catalyst and computed anew for every edge.
    """
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda edge: edge <= value)))


def limits_passed(limits: Sequence[float], value: Column) -> Column:
    """How many of the ascending fixed limits are <= value; 0 for a null value."""
    steps = F.lit(0)
    for count, limit in enumerate(limits, start=1):
        steps = F.when(value >= limit, F.lit(count)).otherwise(steps)
    return steps


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def micros(timestamp: Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps count as UTC, whatever the session's zone."""
    wall = F.convert_timezone(F.lit("UTC"), F.current_timezone(), timestamp.cast("timestamp_ntz"))
    zoneless = F.typeof(timestamp) == "timestamp_ntz"  # known when planned, so one of the two stays
    return F.when(zoneless, F.unix_micros(wall.cast("timestamp"))).otherwise(F.unix_micros(timestamp.cast("timestamp")))


def utc_hour(timestamp: Column) -> Column:
    return F.pmod(F.floor(micros(timestamp) / 3_600_000_000), F.lit(24)).cast("int")


def utc_weekday(timestamp: Column) -> Column:
    """0 for Monday; the epoch began on a Thursday."""
    return F.pmod(F.floor(micros(timestamp) / 86_400_000_000) + 3, F.lit(7)).cast("int")


def utc_stamp(text: Column) -> Column:
    """Text as a timestamp; without an offset it is in UTC."""
    has_zone = F.rtrim(text).rlike(r"(?i)(z|utc|gmt|[+-]\d{1,2}(:?\d{2})?)$") & text.contains(":")
    wall = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.to_timestamp_ntz(text))
    return F.when(has_zone, F.to_timestamp(text)).otherwise(wall.cast("timestamp"))
