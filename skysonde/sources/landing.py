"""Live input as files landing in a directory."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysonde import schemas
from skysonde.sources.messages import numbered_in_place, with_place
from skysonde.sources.storage import discarded, remove_folder, stored_table


def stream_modes_messages(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Decoded Mode S messages as they land (Parquet)."""
    reader = spark.readStream.schema(schemas.MODES_MESSAGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def stream_datalink_lines(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Datalink lines as they land (Parquet with seq, received_at, line)."""
    reader = spark.readStream.schema(schemas.VDL2_LINES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def stream_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text lines stamped with their time of arrival."""
    return spark.readStream.text(path).select(
        F.current_timestamp().alias("received_at"), F.col("value").alias("line")
    )


def number_arrivals(
    spark: SparkSession, landed: str, table: str, checkpoint: str, available_now: bool = False, files: int | None = None
) -> StreamingQuery:
    """Text lines as they land, each with a running number, into a table (seq, received_at, line, batch).

    Files go by time of landing, then by name.  Which files make a batch is fixed by the
    stream's checkpoint, and where its numbers begin by what the batch before it left, so
    numbers are the same over restarts and repeated batches, and later arrivals go on from
    them.
    """
    reader = spark.readStream
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    writer = with_place(reader.text(landed)).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: _number(batch, batch_id, table))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _number(batch: DataFrame, batch_id: int, table: str) -> None:
    """Number the lines of a batch from where the one before it ended; repeating it replaces its rows."""
    spark = batch.sparkSession
    ends = f"{table.rstrip('/')}-ends"
    held = stored_table(spark, ends)
    upto = held.where(F.col("batch") < batch_id).agg(F.max("upto").alias("upto")).first().upto if held is not None else None
    with discarded(spark):
        rows = numbered_in_place(batch, ("_arrived", "_file", "_block"), upto or 0)
        stamped = rows.select("seq", F.current_timestamp().alias("received_at"), "line", F.lit(batch_id).alias("batch"))
        _replace(stamped, table)
    own = spark.read.parquet(table).where(F.col("batch") == batch_id).agg(F.max("seq").alias("last"))
    _replace(own.select(F.coalesce("last", F.lit(upto or 0)).cast("long").alias("upto"), F.lit(batch_id).alias("batch")), ends)
    if held is not None:  # a repeated batch needs the end before it, and no earlier one
        for row in held.where(F.col("batch") < batch_id - 1).select("batch").distinct().collect():
            remove_folder(spark, f"{ends}/batch={row.batch}")


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def stream_observations(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schemas.OBSERVATIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
