"""Temperature and wind derived from aircraft speeds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.geo import magnetic_declination
from skysonde.functions.units import knots_to_ms


def air_temperature_c(true_air_ms: Column, mach: Column) -> Column:
    """Temperature from the speed of sound; NULL unless Mach is positive."""
    sound = true_air_ms / mach
    kelvin = sound * sound * F.lit(S.MOLAR_MASS_AIR / S.HEAT_RATIO_AIR / S.GAS_CONSTANT)
    return F.when(mach > 0, kelvin - F.lit(S.KELVIN_OFFSET))


def wind_struct(x: Column, y: Column, angle: Column, speed: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), angle.alias("angle"), speed.alias("speed"))


def from_angle_deg(x: Column, y: Column) -> Column:
    """Direction the wind comes from, clockwise from north, in [0, 360)."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(y, x)), F.lit(360.0))


def toward_angle_deg(x: Column, y: Column) -> Column:
    """Direction the wind blows toward, clockwise from north, in [0, 360)."""
    return F.pmod(F.lit(90.0) - F.degrees(F.atan2(y, x)), F.lit(360.0))


def wind_triangle(
    lat: Column,
    lon: Column,
    track_deg: Column,
    ground_ms: Column,
    heading_deg: Column,
    air_ms: Column,
) -> Column:
    """Ground vector minus air vector; the magnetic heading is made true first."""
    track = F.radians(track_deg)
    heading = F.radians(heading_deg - magnetic_declination(lat, lon))
    x = ground_ms * F.sin(track) - air_ms * F.sin(heading)
    y = ground_ms * F.cos(track) - air_ms * F.cos(heading)
    return wind_struct(x, y, from_angle_deg(x, y), F.sqrt(x * x + y * y))


def wind_from_polar(speed_ms: Column, direction_deg: Column) -> Column:
    """Wind vector from speed and the direction it comes from."""
    angle = F.radians(direction_deg)
    return wind_struct(
        -speed_ms * F.sin(angle), -speed_ms * F.cos(angle), direction_deg, speed_ms
    )


def wind_from_knots(speed_kt: Column, direction_deg: Column) -> Column:
    """Wind from knots; NULL unless both speed and direction are present."""
    return F.when(
        speed_kt.isNotNull() & direction_deg.isNotNull(),
        wind_from_polar(knots_to_ms(speed_kt), direction_deg),
    )


def circular_difference_deg(a: Column, b: Column) -> Column:
    """Smallest difference of two directions, at most 180."""
    d = F.abs(a - b)
    return F.when(d > 180, F.lit(360.0) - d).otherwise(d)
