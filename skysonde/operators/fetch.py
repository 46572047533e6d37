"""Range reads: raw, latest, and down-sampled."""

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.operators.filters import allowed_columns, grid_rows, quality_rows
from skysonde.operators.topn import time_limited


def fetch_range(
    observations: DataFrame,
    start: Column,
    end: Column,
    distance_km: float = S.DISTANCE_LIMIT_KM,
    columns: Sequence[str] | None = None,
    max_altitude: float | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Fit rows of a period, all of them, or the first `limit` in time order."""
    rows = quality_rows(observations, start, end, distance_km, max_altitude)
    if limit is not None:
        rows = time_limited(rows, limit)
    return rows.select(*allowed_columns(columns))


def was_truncated(
    observations: DataFrame,
    start: Column,
    end: Column,
    limit: int,
    distance_km: float = S.DISTANCE_LIMIT_KM,
    max_altitude: float | None = None,
) -> DataFrame:
    """One row: how many rows the period has and whether the limit cuts some off."""
    rows = quality_rows(observations, start, end, distance_km, max_altitude)
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "truncated", F.col("rows") > limit
    )


def fetch_measures(
    observations: DataFrame,
    start: Column,
    end: Column,
    distance_km: float = S.DISTANCE_LIMIT_KM,
    max_altitude: float | None = None,
    wind: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Measures of a period for the views; whole unless a limit is given."""
    rows = quality_rows(observations, start, end, distance_km, max_altitude)
    if limit is not None:
        rows = time_limited(rows, limit)
    return rows.select("time", "altitude", "temperature", *(S.WIND_COLUMNS if wind else ()))


def fetch_latest(
    observations: DataFrame,
    limit: int,
    distance_km: float | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Latest rows with altitude and a sane temperature, newest first."""
    rows = observations.where(
        F.col("altitude").isNotNull() & (F.col("temperature") > S.TEMPERATURE_FLOOR_C)
    )
    if distance_km is not None:
        rows = rows.where(F.col("distance") <= distance_km)
    return time_limited(rows, limit, latest=True).select(*allowed_columns(columns))


def fetch_grid_by_time(
    grid: DataFrame, start: Column, end: Column, max_altitude: float | None = None
) -> DataFrame:
    """Grid rows at their true observation time, in time order."""
    rows = grid_rows(grid, start, end, max_altitude)
    return rows.select("time", "altitude", "temperature", *S.WIND_COLUMNS).orderBy("time", "altitude", "temperature")


def fetch_grid_measures(
    grid: DataFrame,
    start: Column,
    end: Column,
    max_altitude: float | None = None,
    wind: bool = False,
) -> DataFrame:
    """Grid rows with the bucket start as their time."""
    rows = grid_rows(grid, start, end, max_altitude)
    return rows.select(
        F.col("time_bucket").alias("time"),
        "altitude",
        "temperature",
        *(S.WIND_COLUMNS if wind else ()),
    )


def detail_level(period: timedelta) -> str:
    """Which table serves a period: `raw`, `half_hour` or `three_hour`."""
    days = period.total_seconds() / 86_400
    if days <= S.RAW_MAX_DAYS:
        return "raw"
    return "half_hour" if days <= S.HALF_HOUR_MAX_DAYS else "three_hour"


def detail_level_column(days: Column) -> Column:
    """The same choice as a column, for tables of periods."""
    return (
        F.when(days <= S.RAW_MAX_DAYS, "raw")
        .when(days <= S.HALF_HOUR_MAX_DAYS, "half_hour")
        .otherwise("three_hour")
    )


def grid_or_raw(
    grid: DataFrame | None,
    observations: DataFrame,
    start: Column,
    end: Column,
    max_altitude: float | None = None,
    wind: bool = False,
) -> DataFrame:
    """Grid rows of the period, or raw rows when the grid is missing or has none.

    Whether the grid has rows is a scalar subquery of the same plan, so nothing
    runs ahead of the query.  It gives the end of the raw read: when the grid has
    rows that lies before the start, and neither directories nor row groups of the
    raw table are read.
    """

    def raw(until: Column) -> DataFrame:
        return fetch_measures(observations, start, until, max_altitude=max_altitude, wind=wind)

    if grid is None:
        return raw(end)
    sampled = fetch_grid_measures(grid, start, end, max_altitude, wind)
    nothing = start - F.expr("INTERVAL 1 DAY")
    until = sampled.limit(1).agg(
        F.when(F.count(F.lit(1)) == 0, end).otherwise(nothing).alias("until")
    )
    return sampled.unionByName(raw(until.scalar()))


def fetch_summary(rows: DataFrame) -> DataFrame:
    """Row count and time extent of a fetch."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
    )


def fetch_sample(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of a fetch in time order; ties go by the other columns."""
    return rows.orderBy("time", *[c for c in rows.columns if c != "time"]).limit(n)
