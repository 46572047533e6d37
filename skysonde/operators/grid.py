"""Down-sampled time x altitude grids and their upkeep."""

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.timebins import align_to_bucket, altitude_bin, time_bucket
from skysonde.operators.filters import quality_rows
from skysonde.sources.storage import materialized, remove_folder, stored_table

_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class GridSpec:
    name: str
    bucket_seconds: int
    refresh_seconds: int


HALF_HOUR_GRID = GridSpec("half_hour", S.HALF_HOUR_S, S.HALF_HOUR_REFRESH_S)
THREE_HOUR_GRID = GridSpec("three_hour", S.THREE_HOUR_S, S.THREE_HOUR_REFRESH_S)
GRIDS = (HALF_HOUR_GRID, THREE_HOUR_GRID)


def with_cell(df: DataFrame, spec: GridSpec) -> DataFrame:
    return df.withColumns(
        {
            "time_bucket": time_bucket(F.col("time"), spec.bucket_seconds),
            "altitude_bin": altitude_bin(F.col("altitude")),
        }
    )


def first_per_group(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order.

    Spark keeps one row per group before the shuffle as well, so hot groups do
    not travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") == 1).drop("_row")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each cell; time ties go to the higher obs_id."""
    return first_per_group(rows, ["time_bucket", "altitude_bin"], F.desc("time"), F.desc_nulls_last("obs_id"))


def _cells(observations: DataFrame, spec: GridSpec, distance_km: float = S.DISTANCE_LIMIT_KM) -> DataFrame:
    """Newest fit observation of each cell, with its obs_id."""
    fit = with_cell(quality_rows(observations, distance_km=distance_km), spec)
    return _newest(fit.select("time_bucket", "altitude_bin", *S.GRID_VALUES, "obs_id"))


def representative_grid(
    observations: DataFrame,
    spec: GridSpec,
    distance_km: float = S.DISTANCE_LIMIT_KM,
) -> DataFrame:
    """Newest fit observation of each (time bucket, altitude bin): a real row, no mean.

    Time ties go to the higher obs_id.
    """
    return _cells(observations, spec, distance_km).drop("obs_id")


def write_grid(grid: DataFrame, path: str) -> None:
    """Full rebuild: replace the stored grid."""
    _write(grid, path, "static")


def merge_rows(rows: DataFrame, spec: GridSpec, path: str) -> None:
    """Take new observations up into the stored grid: each cell keeps the newest row it ever had.

    Only the new rows and the stored days they touch are read, and those days are replaced
    in one commit, so that a reader sees them as they were or as they are.  Merging rows
    again changes nothing.  When observations are removed, use `replace_days`.
    """
    spark = rows.sparkSession
    new = materialized(_cells(rows, spec).withColumn("date", F.to_date("time_bucket")), "cells")
    days = [r.date for r in new.select("date").distinct().collect()]
    if not days:
        return
    stored = stored_table(spark, path)
    if stored is not None:
        new = stored.where(F.col("date").isin(days)).unionByName(new, allowMissingColumns=True)
    _write(_newest(new).drop("date"), path, "dynamic")


def _write(grid: DataFrame, path: str, overwrite: str) -> None:
    (
        grid.withColumn("date", F.to_date("time_bucket"))
        .hint("rebalance", "date")
        .sortWithinPartitions("time_bucket", "altitude_bin")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", overwrite)
        .partitionBy("date")
        .parquet(path)
    )


def replace_days(observations: DataFrame, spec: GridSpec, path: str, touched: Column) -> None:
    """Recompute the grid from the given observations and replace the touched days by it.

    `touched` tells of the `date` of a stored day whether it is replaced; a day that
    has no rows left goes.  Days are few: their dates pass through the driver.
    """
    spark = observations.sparkSession
    _write(_cells(observations, spec), path, "dynamic")
    cells = with_cell(quality_rows(observations), spec)
    filled = cells.select(F.to_date("time_bucket").alias("date")).distinct()
    stored = spark.read.parquet(path).where(touched).select(F.to_date("date").alias("date")).distinct()
    for row in stored.join(filled, "date", "left_anti").collect():
        remove_folder(spark, f"{path.rstrip('/')}/date={row.date.isoformat()}")


def rebuild_grid(observations: DataFrame, spec: GridSpec, path: str) -> None:
    write_grid(_cells(observations, spec), path)


def refresh_start(spec: GridSpec, now: Column) -> Column:
    """First bucket that the refresh recomputes."""
    return align_to_bucket(
        now - F.expr(f"INTERVAL {spec.refresh_seconds} SECONDS"), spec.bucket_seconds
    )


def refresh_grid(observations: DataFrame, spec: GridSpec, path: str, now: Column) -> None:
    """Recompute the buckets of the refresh window.

    Storage is replaced by whole days, so the recomputation starts at the first
    day the window touches; days before it are not read or written.
    """
    first_day = F.to_date(refresh_start(spec, now))
    recent = observations.where(
        F.col("time").cast("timestamp") >= first_day.cast("timestamp")
    )
    if "date" in observations.columns:
        recent = recent.where(F.col("date") >= first_day)
    replace_days(recent, spec, path, F.col("date") >= first_day)


def refresh_all(
    observations: DataFrame, paths: dict[str, str], now: Column, rebuild: bool = False
) -> dict[str, bool]:
    """Refresh (or rebuild) every grid; one failing does not stop the other."""
    done = {}
    for spec in GRIDS:
        try:
            if rebuild:
                rebuild_grid(observations, spec, paths[spec.name])
            else:
                refresh_grid(observations, spec, paths[spec.name], now)
            done[spec.name] = True
        except Exception:  # noqa: BLE001 - each grid stands alone
            _LOG.exception("the %s grid was not refreshed", spec.name)
            done[spec.name] = False
    return done


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A stored grid.  The ids of its rows decide ties when it is merged and are of no use to readers."""
    return spark.read.parquet(path).drop("obs_id")


def refreshed_state(
    stored: DataFrame, observations: DataFrame, spec: GridSpec, now: Column
) -> DataFrame:
    """Grid contents after a refresh, as one plan: kept buckets plus recomputed ones."""
    start = refresh_start(spec, now).cast("timestamp_ntz")
    kept = stored.where(F.col("time_bucket") < start)
    return kept.unionByName(
        representative_grid(observations.where(F.col("time") >= start), spec)
    )
