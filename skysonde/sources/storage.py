"""The folder shared by all executors, for checkpoints and intermediate tables."""

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` as the session names it.

    A session of a single process, such as a test's, may go without: it gets a
    folder below its warehouse, which it has to itself as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    if spark.conf.get("spark.master", "").partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/skysonde-shared"


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/skysonde-{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, None while there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


_WRITTEN = threading.local()


@contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialized` writes inside are removed when the block ends.

    For work that is done within the block, such as a micro-batch of a stream.
    """
    outer, _WRITTEN.paths = getattr(_WRITTEN, "paths", None), []
    try:
        yield
    finally:
        for path in _WRITTEN.paths:
            remove_folder(spark, path)
        _WRITTEN.paths = outer


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read back.

    Used where several later steps need the same costly rows: they are computed
    once, survive lost executors, and stay columnar.  The folder stays for whoever reads
    the result, unless `discarded` surrounds the work.
    """
    path = fresh_folder(df.sparkSession, purpose)
    if getattr(_WRITTEN, "paths", None) is not None:
        _WRITTEN.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
