"""Distances and magnetic declination as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysonde import settings as S


def haversine_km(
    lat: Column,
    lon: Column,
    ref_lat: float = S.REFERENCE_LATITUDE,
    ref_lon: float = S.REFERENCE_LONGITUDE,
) -> Column:
    """Great-circle distance to the reference point, km."""
    half_dlat = F.radians(lat - F.lit(ref_lat)) / 2
    half_dlon = F.radians(lon - F.lit(ref_lon)) / 2
    chord = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(F.lit(ref_lat))) * F.cos(
        F.radians(lat)
    ) * F.pow(F.sin(half_dlon), F.lit(2.0))
    return F.lit(2 * S.EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def flat_distance_km(
    lat: Column,
    lon: Column,
    ref_lat: float = S.REFERENCE_LATITUDE,
    ref_lon: float = S.REFERENCE_LONGITUDE,
) -> Column:
    """Quick local distance: degrees to km, longitude shrunk at the reference."""
    north = (lat - F.lit(ref_lat)) * F.lit(S.KM_PER_DEGREE)
    east = (lon - F.lit(ref_lon)) * F.lit(S.KM_PER_DEGREE) * F.cos(F.radians(F.lit(ref_lat)))
    return F.sqrt(north * north + east * east)


def magnetic_declination(lat: Column, lon: Column) -> Column:
    """Declination in degrees, west positive (quadratic fit around Japan)."""
    u = lat - F.lit(S.DECLINATION_ORIGIN[0])
    v = lon - F.lit(S.DECLINATION_ORIGIN[1])
    powers = (F.lit(1.0), u, v, u * u, u * v, v * v)
    total = F.lit(0.0)
    for weight, power in zip(S.DECLINATION_TERMS, powers):
        total = total + F.lit(weight) * power
    return total
