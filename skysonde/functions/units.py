"""Unit conversions and small numeric helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysonde import settings as S


def feet_to_metres(feet: Column) -> Column:
    return feet * F.lit(S.FEET_TO_METRES)


def knots_to_ms(knots: Column) -> Column:
    return knots * F.lit(S.KNOTS_TO_MS)


def metres_to_whole_feet(metres: Column) -> Column:
    """Feet with the fraction cut off, as filled-in altitudes are used."""
    return (metres / F.lit(S.FEET_TO_METRES)).cast("int")


def finite(value: Column) -> Column:
    """True for values that are neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
