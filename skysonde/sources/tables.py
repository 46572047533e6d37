"""Observation and grid tables on shared storage."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.operators.filters import storage_form


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation table; filters on `date` prune directories, others reach Parquet."""
    return spark.read.parquet(path)


def read_observations_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """The same table behind a database; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def with_date(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn("date", F.to_date(time))


def append_observations(observations: DataFrame, path: str, ingest_time: Column | None = None) -> None:
    """Append rows in storage form, one directory per day.

    The stored time is the time of arrival: pass `ingest_time` to stamp the rows,
    leave it out when `time` already is the arrival time.  Rebalancing by day lets
    a day with much data become several files and small days share a task.
    """
    rows = observations if ingest_time is None else observations.withColumn("time", ingest_time)
    (
        with_date(storage_form(rows))
        .hint("rebalance", "date")
        .sortWithinPartitions("time")
        .write.mode("append")
        .partitionBy("date")
        .parquet(path)
    )


def naive_to_zoned(df: DataFrame, time: str = "time", zone: str = S.LOCAL_ZONE) -> DataFrame:
    """Reinterpret naive local times as instants; a zoned column is left alone."""
    if dict(df.dtypes)[time] != "timestamp_ntz":
        return df
    return df.withColumn(time, F.to_utc_timestamp(F.col(time).cast("timestamp"), zone))
