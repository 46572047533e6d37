"""Live collection: landed messages of both methods into one observation table."""

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysonde import settings as S
from skysonde.operators.asof import fill_altitude, report_observations
from skysonde.operators.filters import drop_absurd_temperature
from skysonde.sources import messages, tables
from skysonde.sources.storage import discarded, materialized, remove_folder, stored_table
from skysonde.streaming import fragments, jobs


POSITIONS = (
    "seq long, time timestamp, icao string, callsign string, altitude_m double, "
    "latitude double, longitude double"
)


@dataclass(frozen=True)
class LiveTables:
    """Tables of a live collection, below one folder of the shared storage."""

    folder: str
    grids: dict[str, str] | None = None

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"


def _keep(rows: DataFrame, batch_id: int, path: str) -> None:
    """Rows of a batch in a table by day; a repeated batch replaces what it wrote before.

    Batches lie below their days, so that a reader of a few days lists those only.
    """
    (
        rows.withColumn("batch", F.lit(batch_id))
        .hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "batch")
        .parquet(path)
    )


def drop_days_before(store: LiveTables, spark: SparkSession, last: date) -> None:
    """Remove days of the tables that no later report can reach; `last` is the first day to keep."""
    for name in ("positions", "xid", "taken"):
        table = stored_table(spark, store.path(name))
        if table is None:
            continue
        for row in table.where(F.col("date") < F.lit(last)).select("date").distinct().collect():
            remove_folder(spark, f"{store.path(name)}/date={row.date.isoformat()}")


def collect_positions(positions: DataFrame, store: LiveTables, available_now: bool = False) -> StreamingQuery:
    """Position reports into the history table that altitudes are filled from, by day."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _keep(tables.with_date(batch), batch_id, store.path("positions"))

    return jobs._start(positions, each, store.path("marks/positions"), available_now)


def collect_modes(
    stream: DataFrame,
    store: LiveTables,
    ttl_s: int = S.FRAGMENT_TTL_S,
    available_now: bool = False,
    filter_outliers: bool = True,
) -> StreamingQuery:
    """Mode S messages, paired per aircraft, into the observation table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        found = drop_absurd_temperature(fragments.pair_observations(batch))
        # even batch ids in the table are those of this stream, odd ones of the other
        _store(found, 2 * batch_id, store, filter_outliers)

    return jobs._start(fragments.live_pairs(stream, ttl_s), each, store.path("marks/modes"), available_now)


def collect_datalink(
    lines: DataFrame,
    store: LiveTables,
    window_s: int = S.POSITION_WINDOW_S,
    xid_timeout_s: int = S.FRAGMENT_TTL_S,
    available_now: bool = False,
    filter_outliers: bool = True,
    keep_days: int | None = None,
) -> StreamingQuery:
    """Datalink lines, through the whole altitude cascade, into the observation table.

    A batch's reports look for their altitude in themselves, in the stored positions of
    the days they touch, and in the XIDs stored so far.  An XID serves the first report
    that asks, whatever batches the two are in.  With `keep_days`, positions and XIDs of
    days further back from a batch are removed once it is stored.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with discarded(batch.sparkSession):
            take(batch.sparkSession, batch, batch_id)

    def take(spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        docs = messages.parse_datalink(batch)
        xid = messages.xid_reports(docs)
        _keep(tables.with_date(xid, "received_at"), batch_id, store.path("xid"))
        reports = messages.acars_reports(docs)
        first, last = jobs._batch_days(reports.select(F.col("received_at").alias("time")))
        filled = fill_altitude(
            reports,
            _near(spark, store.path("positions"), POSITIONS, first, last, window_s),
            _near(spark, store.path("xid"), xid.schema, first, last, xid_timeout_s),
            window_s,
            xid_timeout_s,
        )
        taken = stored_table(spark, store.path("taken"))
        if taken is not None:
            # an XID was taken within its reach of the reports of this batch, or can't be now
            near = _days_near(taken, first, last, 2 * xid_timeout_s)
            earlier = near.where(F.col("batch") < batch_id).select("xid_seq").distinct()
            filled = filled.join(earlier, "xid_seq", "left_anti")
        filled = materialized(filled, "filled")
        used = filled.where("xid_seq IS NOT NULL").select("seq", "xid_seq", F.to_date("received_at").alias("date"))
        _keep(used, batch_id, store.path("taken"))
        found = drop_absurd_temperature(report_observations(filled))
        _store(found, 2 * batch_id + 1, store, filter_outliers)
        if keep_days is not None and first is not None:
            drop_days_before(store, spark, first - timedelta(days=keep_days))

    return jobs._start(lines, each, store.path("marks/datalink"), available_now)


def _store(found: DataFrame, batch_id: int, store: LiveTables, filter_outliers: bool) -> None:
    rows = found.withColumn("time", F.col("time").cast("timestamp"))
    jobs.store_arrived(
        rows, batch_id, store.path("observations"), store.path("quarantine"), filter_outliers, store.grids
    )


def _near(spark: SparkSession, path: str, schema, first, last, reach_s: int) -> DataFrame:
    """Stored rows of the days that a batch, widened by the reach, touches; none at first."""
    rows = stored_table(spark, path)
    if rows is None:
        return spark.createDataFrame([], schema)
    return _days_near(rows, first, last, reach_s).drop("date", "batch")


def _days_near(rows: DataFrame, first: date | None, last: date | None, reach_s: int) -> DataFrame:
    """Rows of the days from `first` to `last` and of those within the reach, as a filter on directories."""
    if first is None:
        return rows
    days = timedelta(days=-(-reach_s // 86_400))
    return rows.where(F.col("date").between(F.lit(first - days), F.lit(last + days)))
