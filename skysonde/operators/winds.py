"""Wind field on time x altitude bins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.physics import toward_angle_deg
from skysonde.functions.timebins import micros

DAY_MICROS = 86_400_000_000


def time_bin_count(span_micros: Column) -> Column:
    """48 bins up to a day, 24 up to three days, then one per six hours."""
    days = span_micros / F.lit(float(DAY_MICROS))
    return (
        F.when(days <= 1, F.lit(48))
        .when(days <= 3, F.lit(24))
        .otherwise((days * 4).cast("int"))
    )


def wind_field(rows: DataFrame, limited: bool = False) -> DataFrame:
    """Mean wind per time and altitude bin, with speed and the direction blown toward.

    The bin edges come from the extent of the rows, read as one scalar subquery.
    """
    wanted = rows.where(
        F.col("wind_x").isNotNull() & F.col("wind_y").isNotNull() & F.col("altitude").isNotNull()
    ).withColumn("_t", micros(F.col("time")))
    extent = (
        wanted.agg(F.min("_t").alias("first"), F.max("_t").alias("last"))
        .select(
            F.struct(
                "first",
                (F.col("last") - F.col("first")).alias("span"),
                time_bin_count(F.col("last") - F.col("first")).alias("bins"),
            ).alias("extent")
        )
        .scalar()
    )
    step, last_bin = (
        (S.WIND_ALTITUDE_STEP_LIMITED_M, S.WIND_ALTITUDE_LAST_BIN_LIMITED)
        if limited
        else (S.WIND_ALTITUDE_STEP_M, S.WIND_ALTITUDE_LAST_BIN)
    )
    known = wanted.withColumn("_e", extent)
    bins = F.col("_e.bins")
    # The newest instant belongs to the last bin, as does everything when the span is zero.
    raw = F.floor(
        (F.col("_t") - F.col("_e.first")) * bins / F.nullif(F.col("_e.span"), F.lit(0))
    )
    time_bin = F.coalesce(F.least(raw, bins - 1), bins - 1)
    level = F.floor(F.col("altitude") / F.lit(step))
    alt_bin = F.greatest(F.lit(0), F.least(level, F.lit(last_bin)))
    cells = known.select(
        time_bin.cast("int").alias("time_bin"),
        alt_bin.cast("int").alias("alt_bin"),
        "wind_x",
        "wind_y",
        "_t",
    )
    means = cells.groupBy("time_bin", "alt_bin").agg(
        F.avg("wind_x").alias("wind_x"),
        F.avg("wind_y").alias("wind_y"),
        F.avg(F.col("_t") / F.lit(float(DAY_MICROS))).alias("mean_day"),
    )
    x, y = F.col("wind_x"), F.col("wind_y")
    return means.select(
        "time_bin",
        "alt_bin",
        (F.col("alt_bin") * step).alias("altitude_bin"),
        "mean_day",
        "wind_x",
        "wind_y",
        F.sqrt(x * x + y * y).alias("wind_speed"),
        toward_angle_deg(x, y).alias("toward_angle"),
    )


def unit_arrows(field: DataFrame) -> DataFrame:
    """Field with unit direction components and the speed on its colour scale."""
    speed = F.col("wind_speed")
    return field.withColumns(
        {
            "unit_x": F.col("wind_x") / F.nullif(speed, F.lit(0.0)),
            "unit_y": F.col("wind_y") / F.nullif(speed, F.lit(0.0)),
            "shown_speed": F.least(speed, F.lit(S.WIND_SPEED_SCALE_MAX)),
        }
    )
