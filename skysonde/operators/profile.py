"""Vertical structure: temperature profile, standard line, hodograph."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.timebins import altitude_bin
from skysonde.operators.medians import exact_median, exact_medians

TEMPERATURE_CELL_C = 0.25
WIND_CELL_MS = 0.25


def _with_bin(df: DataFrame) -> DataFrame:
    return df.withColumn("altitude_bin", altitude_bin(F.col("altitude")))


def _centre() -> Column:
    return F.col("altitude_bin") + F.lit(S.ALTITUDE_BIN_M / 2)


def temperature_profile(rows: DataFrame) -> DataFrame:
    """Median temperature per altitude bin of 250 m."""
    medians = exact_median(
        _with_bin(rows), "altitude_bin", "temperature", TEMPERATURE_CELL_C, "median_temperature"
    )
    return medians.withColumn("altitude_centre", _centre())


def standard_atmosphere(profile: DataFrame, limited: bool = False) -> DataFrame:
    """Standard lapse-rate line through the lowest bin of a profile."""
    top = S.ALTITUDE_LIMITED_M if limited else S.ALTITUDE_MAX_M
    step = top / (S.PROFILE_LINE_POINTS - 1)
    ground = profile.agg(
        F.min_by(
            F.col("median_temperature")
            + F.lit(S.LAPSE_RATE_C_PER_KM) * F.col("altitude_centre") / F.lit(1000.0),
            F.col("altitude_bin"),
        ).alias("surface_temperature")
    ).where(F.col("surface_temperature").isNotNull())
    points = ground.select(
        "surface_temperature",
        F.explode(F.sequence(F.lit(0), F.lit(S.PROFILE_LINE_POINTS - 1))).alias("point"),
    ).withColumn("altitude", F.col("point") * F.lit(step))
    return points.select(
        "point",
        "altitude",
        (
            F.col("surface_temperature")
            - F.lit(S.LAPSE_RATE_C_PER_KM) * F.col("altitude") / F.lit(1000.0)
        ).alias("temperature"),
    )


def hodograph(rows: DataFrame) -> DataFrame:
    """Median wind components per altitude bin of 250 m."""
    medians = exact_medians(
        _with_bin(rows),
        "altitude_bin",
        ("wind_x", "wind_y"),
        WIND_CELL_MS,
        ("median_wind_x", "median_wind_y"),
    )
    return medians.withColumn("altitude_centre", _centre())


def hodograph_segments(points: DataFrame) -> DataFrame:
    """Lines between consecutive bins; a segment's altitude is the mean of its ends.

    One row per altitude bin comes in, so the single ordered window is tiny.
    """
    upward = Window.orderBy("altitude_bin")
    ends = points.withColumns(
        {
            "next_wind_x": F.lead("median_wind_x").over(upward),
            "next_wind_y": F.lead("median_wind_y").over(upward),
            "_next_centre": F.lead("altitude_centre").over(upward),
        }
    ).where(F.col("_next_centre").isNotNull())
    return ends.select(
        "altitude_bin",
        F.col("median_wind_x").alias("from_x"),
        F.col("median_wind_y").alias("from_y"),
        F.col("next_wind_x").alias("to_x"),
        F.col("next_wind_y").alias("to_y"),
        ((F.col("altitude_centre") + F.col("_next_centre")) / 2).alias("segment_altitude"),
    )
