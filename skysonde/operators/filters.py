"""Row filters and projections on observation tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.timebins import epoch_days, wall_clock
from skysonde.functions.units import finite


def allowed_columns(
    requested: Sequence[str] | None, valid: Sequence[str] = S.OBSERVATION_COLUMNS
) -> list[str]:
    """Known names out of `requested`; an error when none is left."""
    names = [c for c in (S.DEFAULT_COLUMNS if requested is None else requested) if c in valid]
    if not names:
        raise ValueError("none of the requested columns exists")
    return names


def select_allowed(df: DataFrame, requested: Sequence[str] | None = None) -> DataFrame:
    return df.select(*allowed_columns(requested))


def quality_rows(
    df: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    distance_km: float = S.DISTANCE_LIMIT_KM,
    max_altitude: float | None = None,
) -> DataFrame:
    """Rows fit for analysis: near enough, altitude in range, temperature sane."""
    top = S.ALTITUDE_MAX_M if max_altitude is None else min(max_altitude, S.ALTITUDE_MAX_M)
    kept = df.where(
        (F.col("distance") <= distance_km)
        & F.col("altitude").isNotNull()
        & (F.col("altitude") >= S.ALTITUDE_MIN_M)
        & (F.col("altitude") <= top)
        & (F.col("temperature") > S.TEMPERATURE_FLOOR_C)
    )
    return within(kept, "time", start, end)


def within(df: DataFrame, time: str, start: Column | None, end: Column | None) -> DataFrame:
    """Rows with start <= time <= end; a missing bound is open.

    On a table stored by day the bounds are put on `date` as well, which leaves
    whole directories unread.
    """
    by_day = "date" in df.columns
    if start is not None:
        df = df.where(F.col(time) >= start)
        df = df.where(F.col("date") >= F.to_date(start)) if by_day else df
    if end is not None:
        df = df.where(F.col(time) <= end)
        df = df.where(F.col("date") <= F.to_date(end)) if by_day else df
    return df


def grid_rows(
    df: DataFrame, start: Column, end: Column, max_altitude: float | None = None
) -> DataFrame:
    """Grid rows by bucket start.

    The bucket that holds `start` is left out unless `start` is its edge, and the
    whole bucket that holds `end` is kept.
    """
    kept = within(df, "time_bucket", start, end)
    return kept if max_altitude is None else kept.where(F.col("altitude") <= max_altitude)


def is_valid_observation(wind: str = "wind_x") -> Column:
    """An identifier, some weather, and a positive altitude."""
    return (
        (F.col("icao").isNotNull() | F.col("callsign").isNotNull())
        & (F.col("temperature").isNotNull() | F.col(wind).isNotNull())
        & F.coalesce(F.col("altitude") > 0, F.lit(False))
    )


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows whose temperature and altitude can be drawn."""
    return df.where(
        finite(F.col("temperature"))
        & finite(F.col("altitude"))
        & (F.col("temperature") > S.TEMPERATURE_FLOOR_C)
        & F.col("altitude").between(S.ALTITUDE_MIN_M, S.ALTITUDE_MAX_M)
    )


def drop_absurd_temperature(df: DataFrame) -> DataFrame:
    """Temperature present and not below the floor (the floor itself stays)."""
    return df.where(F.col("temperature") >= S.TEMPERATURE_FLOOR_C)


def windy_rows(df: DataFrame, limited: bool = False) -> DataFrame:
    """Rows with more than calm wind, optionally only the low ones."""
    x, y = F.col("wind_x"), F.col("wind_y")
    kept = df.where(F.sqrt(x * x + y * y) > S.CALM_WIND_MS)
    return kept.where(F.col("altitude") <= S.ALTITUDE_LIMITED_M) if limited else kept


def altitude_band(limited: bool = False) -> Column:
    """Label of the altitude band holding the row, NULL outside all bands.

    The bands do not overlap, so a `when` chain over these few constants does the
    job of a join.
    """
    bands = S.TEMPERATURE_BANDS_LIMITED if limited else S.TEMPERATURE_BANDS
    label = F.lit(None).cast("int")
    for low, high in bands:
        label = F.when(F.col("altitude").between(low, high), F.lit((low + high) // 2)).otherwise(
            label
        )
    return label


def band_rows(df: DataFrame, limited: bool = False) -> DataFrame:
    bands = S.TEMPERATURE_BANDS_LIMITED if limited else S.TEMPERATURE_BANDS
    inside = F.lit(False)
    for low, high in bands:
        inside = inside | F.col("altitude").between(low, high)
    return df.where(inside).withColumn("band", altitude_band(limited))


def tail_bounds(
    df: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    hours: int = S.PROFILE_WINDOW_H,
) -> tuple[Column, Column]:
    """Bounds of the last hours of a request.

    Without `end` the latest row counts; it is a scalar subquery, so the bound
    reaches the scan as a pushed filter.
    """
    last = df.agg(F.max("time").alias("end")).scalar() if end is None else end
    first = last - F.expr(f"INTERVAL {hours} HOURS")
    return (first if start is None else F.greatest(first, start)), last


def tail_rows(
    df: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    hours: int = S.PROFILE_WINDOW_H,
) -> DataFrame:
    first, last = tail_bounds(df, start, end, hours)
    return df.where((F.col("time") >= first) & (F.col("time") <= last))


def clock_columns(df: DataFrame, time: str = "time") -> DataFrame:
    """Local wall clock, and days since 1970 on that clock."""
    local = wall_clock(F.col(time))
    return df.withColumns({"local_time": local, "day_number": epoch_days(local)})


def storage_form(df: DataFrame) -> DataFrame:
    """Rows as stored: identifier always text, missing numbers as zero."""
    filled = {
        c: F.coalesce(F.col(c), F.lit(0.0))
        for c in (
            "latitude",
            "longitude",
            "temperature",
            "wind_x",
            "wind_y",
            "wind_angle",
            "wind_speed",
        )
        if c in df.columns
    }
    name = F.coalesce(
        F.nullif(F.col("callsign"), F.lit("")), F.nullif(F.col("icao"), F.lit("")), F.lit("")
    )
    return df.withColumns({"callsign": name, **filled})


def minimum_sample(df: DataFrame, keys: Sequence[str] = (), least: int = S.MIN_SAMPLES) -> DataFrame:
    """Groups (or the whole frame) with their row count and an `enough` flag."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("enough", F.col("n") >= least)


def enough_rows(df: DataFrame, least: int = S.MIN_SAMPLES) -> DataFrame:
    """All rows, or none when there are fewer than `least`; no more than those are counted."""
    seen = df.limit(least).agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.where(seen >= least)
