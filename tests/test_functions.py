"""Scalar functions against literal values."""

import pytest
from pyspark.sql import functions as F

from skysonde.functions import geo, physics, timebins, units
from skysonde.functions.identifiers import normal_identifier, strip_callsign
from skysonde.operators import fetch, filters


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def real(x):
    return F.lit(float(x))


def test_temperature_from_speed_and_mach(spark):
    value = one(spark, physics.air_temperature_c(real(250), real(0.8)))
    assert value == pytest.approx(-30.66, abs=0.05)
    assert one(spark, physics.air_temperature_c(real(250), real(0))) is None


def test_wind_triangle(spark):
    wind = one(
        spark,
        physics.wind_triangle(real(35.5), real(137), real(270), real(220), real(265), real(230)),
    )
    assert wind.x == pytest.approx(4.17674, abs=1e-5)
    assert wind.y == pytest.approx(51.42749, abs=1e-5)
    assert wind.angle == pytest.approx(184.64315, abs=1e-5)
    assert wind.speed == pytest.approx(51.59683, abs=1e-5)


def test_declination_at_its_origin(spark):
    assert one(spark, geo.magnetic_declination(real(37), real(138))) == pytest.approx(8 + 15.822 / 60)


def test_wind_from_the_west_blows_east(spark):
    wind = one(spark, physics.wind_from_polar(real(10), real(270)))
    assert (wind.x, wind.y) == (pytest.approx(10), pytest.approx(0, abs=1e-9))
    assert one(spark, physics.wind_from_knots(real(10), F.lit(None).cast("double"))) is None


def test_directions(spark):
    assert one(spark, physics.circular_difference_deg(real(350), real(10))) == pytest.approx(20)
    assert one(spark, physics.toward_angle_deg(real(1), real(0))) == pytest.approx(90)
    assert one(spark, physics.from_angle_deg(real(1), real(0))) == pytest.approx(270)


def test_distances_agree_nearby(spark):
    exact = one(spark, geo.haversine_km(real(35.9), real(139.9)))
    quick = one(spark, geo.flat_distance_km(real(35.9), real(139.9)))
    assert exact == pytest.approx(quick, rel=0.01)


@pytest.mark.parametrize(
    ("utc", "seconds", "expected"),
    [
        ("2024-01-01 03:47:30", 1800, "2024-01-01 03:30:00"),
        ("2024-01-01 05:10:00", 10800, "2024-01-01 03:00:00"),
        ("2024-01-01 03:10:00", 10800, "2024-01-01 03:00:00"),
    ],
)
def test_alignment_on_the_local_clock(spark, utc, seconds, expected):
    time = F.lit(utc).cast("timestamp")
    assert str(one(spark, timebins.align_to_bucket(time, seconds))) == expected
    assert str(one(spark, timebins.time_bucket(time, seconds))) == expected


def test_whole_feet_are_cut_not_rounded(spark):
    assert one(spark, units.metres_to_whole_feet(real(3047.9))) == 9999


def test_identifiers(spark):
    assert one(spark, normal_identifier(F.lit(" jal123 "))) == "JAL123"
    assert one(spark, normal_identifier(F.lit("  "))) is None
    assert one(spark, strip_callsign(F.lit("ANA5__"))) == "ANA5"


def test_column_allow_list():
    assert filters.allowed_columns(["time", "x; DROP", "method"]) == ["time", "method"]
    assert filters.allowed_columns(None) == ["time", "altitude", "temperature", "distance"]
    with pytest.raises(ValueError):
        filters.allowed_columns(["nothing"])


def test_detail_level():
    from datetime import timedelta

    levels = [fetch.detail_level(timedelta(days=d)) for d in (14, 14.01, 90, 91, 365)]
    assert levels == ["raw", "half_hour", "half_hour", "three_hour", "three_hour"]


def test_altitude_caps(spark):
    rows = spark.createDataFrame(
        [(1, 10.0, a, 0.0, None) for a in (-1.0, 0.0, 1999.0, 2001.0, 12999.0, 13001.0)],
        "obs_id long, distance double, altitude double, temperature double, time timestamp_ntz",
    )
    assert filters.quality_rows(rows, max_altitude=2000).count() == 2
    assert filters.quality_rows(rows, max_altitude=99999).count() == 4


def test_fixed_decimals_follow_the_binary_value(spark):
    from skysonde.sources.exports import _fixed

    values = [16.45, 16.35, -16.45, 0.25, 0.35, 2.5, 0.05, 1234.55, 9.95, -0.75]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    shown = [r.t for r in df.select(_fixed(F.col("v"), 1).alias("t")).collect()]
    assert shown == [f"{v:.1f}" for v in values]
