"""The latest accepted rows as a table that micro-batches add to and read from."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.operators.outliers import latest_history
from skysonde.sources.storage import remove_folder, stored_table

#: What a history needs of a row.
COLUMNS = ("obs_id", "time", "altitude", "temperature")


@dataclass(frozen=True)
class HistoryRing:
    """A history of the latest `size` usable rows below one folder of the shared storage.

    Every batch writes its own latest rows (`kind=part`), so many at most as the ring has.
    Every `compact_after` batches the whole ring is written instead (`kind=whole`), and what
    lies before it goes once that batch is done.  So a batch reads one ring and a bounded
    number of parts, however long the stream runs.  A batch sees batches before its own
    only, and writing it again replaces what it wrote: repeating it changes nothing.
    """

    path: str
    size: int = S.HISTORY_SIZE
    compact_after: int = 20

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The ring as the batches before this one left it; None if there were none."""
        table = stored_table(spark, self.path)
        if table is None:
            return None
        earlier = table.where(F.col("batch") < batch_id)
        whole = self._last_whole(earlier)
        kept = (F.col("batch") > whole) | ((F.col("batch") == whole) & (F.col("kind") == "whole"))
        return latest_history(earlier.where(kept).select(*COLUMNS), self.size)

    def accept(self, rows: DataFrame, batch_id: int) -> None:
        """Add the accepted rows of a batch."""
        spark = rows.sparkSession
        own = latest_history(rows.select(*COLUMNS), self.size)
        kind = "part"
        if batch_id % self.compact_after == self.compact_after - 1:
            past, kind = self.before(spark, batch_id), "whole"
            own = own if past is None else latest_history(past.unionByName(own), self.size)
        self._drop_before(spark, batch_id)
        marked = own.withColumns({"kind": F.lit(kind), "batch": F.lit(batch_id)})
        marked.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """The ring as it is now."""
        return self.before(spark, 1 << 62)

    @staticmethod
    def _last_whole(earlier: DataFrame) -> int:
        found = earlier.where("kind = 'whole'").agg(F.max("batch").alias("batch")).first().batch
        return -1 if found is None else found

    def _drop_before(self, spark: SparkSession, batch_id: int) -> None:
        """Remove what a ring written by an earlier batch, which is done now, has in it."""
        table = stored_table(spark, self.path)
        if table is None:
            return
        whole = self._last_whole(table.where(F.col("batch") < batch_id))
        gone = table.where(F.col("batch") <= whole).select("kind", "batch").distinct()
        for row in gone.where(~((F.col("kind") == "whole") & (F.col("batch") == whole))).collect():
            remove_folder(spark, f"{self.path.rstrip('/')}/kind={row.kind}/batch={row.batch}")
