"""Streaming joins and the jobs that feed the stored tables."""

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from skysonde import settings as S
from skysonde.functions.identifiers import normal_identifier
from skysonde.functions.units import finite
from skysonde.operators.asof import SLICE_FACTOR
from skysonde.operators.filters import storage_form
from skysonde.operators.grid import GRIDS, merge_rows, replace_days
from skysonde.operators.outliers import outlier_flags, usable_history
from skysonde.sources.storage import discarded, materialized, stored_table
from skysonde.sources.tables import append_observations, read_observations
from skysonde.streaming.ring import HistoryRing


_PLACES = np.dtype([("at", "i8"), ("seq", "i8"), ("altitude_m", "f8"), ("latitude", "f8"), ("longitude", "f8")])
_WAITING = "places binary, probes string"
_NEAREST = "asked string, at long, altitude_m double, latitude double, longitude double, gap_s double"


def _places(frame: pd.DataFrame) -> np.ndarray:
    out = np.zeros(len(frame), _PLACES)
    for name in _PLACES.names:
        out[name] = frame[name].to_numpy()
    return out


def _in_order(places: np.ndarray) -> np.ndarray:
    """Places in order of time, of those at one instant the one of the last message."""
    places = places[np.lexsort((places["seq"], places["at"]))]
    return places[np.append(places["at"][1:] != places["at"][:-1], True)] if len(places) else places


def _nearest_places(places: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the place nearest to each instant, the later one on a tie, and its gap; -1 out of reach."""
    far = np.iinfo(np.int64).max
    after = np.searchsorted(places["at"], at, side="right")
    # no place before the first, none after the last
    edges = np.concatenate([[0], places["at"], [0]])
    before_gap = np.where(after > 0, at - edges[after], far)
    after_gap = np.where(after < len(places), edges[after + 1] - at, far)
    gap = np.minimum(before_gap, after_gap)
    chosen = np.where(after_gap <= before_gap, after, after - 1)
    return np.where(gap <= reach, chosen, -1), gap


def nearest_position_stream(
    probes: DataFrame,
    positions: DataFrame,
    window_s: int = S.POSITION_WINDOW_S,
    lateness: str = "10 seconds",
) -> DataFrame:
    """Nearest position within `window_s` for each weather row of a stream.

    State is keyed by the aircraft and a time slot ten times as wide as the
    window (positions are listed under every slot they can serve), so the state of
    a busy aircraft is spread.  It holds the positions of two windows in order of time, one
    per instant, and the probes that wait, so no pairs are built.  Both sides carry a
    watermark; a probe is answered once that is a window past it, with NULLs if
    no position is in reach.  The newest probes wait until more input arrives.
    """
    reach = window_s * 1_000_000

    def slot(micros: Column) -> Column:
        return F.floor(micros / F.lit(window_s * SLICE_FACTOR * 1_000_000))

    at = F.unix_micros("time")
    aircraft = normal_identifier(F.col("icao")).alias("aircraft")
    time = F.col("time").cast("timestamp").alias("time")
    who = F.struct(probes["seq"], probes["icao"])
    asked = probes.select(aircraft, time, F.to_json(who, {"ignoreNullFields": "false"}).alias("asked"))
    last = F.col("seq").cast("long") if "seq" in positions.columns else F.lit(None).cast("long")
    held = positions.select(
        aircraft,
        time,
        F.coalesce(last, F.lit(-1)).alias("seq"),
        *[F.col(c).cast("double").alias(c) for c in _PLACES.names[2:]],
    ).withWatermark("time", lateness)
    slots = F.sequence(slot(at - F.lit(reach)), slot(at + F.lit(reach)))
    left = asked.withWatermark("time", lateness).select("*", F.explode(F.array(slot(at))).alias("slot"))
    right = held.select("*", F.explode(F.when(F.col("aircraft").isNotNull(), slots)).alias("slot"))
    rows = left.where("slot IS NOT NULL").unionByName(right, allowMissingColumns=True).withColumn("at", at)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (b"", "[]")
        places, waiting = [np.frombuffer(held[0], _PLACES)], {tuple(p) for p in json.loads(held[1])}
        for frame in () if state.hasTimedOut else frames:
            asks = frame["asked"].notna()
            waiting.update(zip(frame.loc[asks, "at"].tolist(), frame.loc[asks, "asked"].tolist()))
            places.append(_places(frame[~asks]))
        known, now = _in_order(np.concatenate(places)), state.getCurrentWatermarkMs() * 1000
        due = sorted(p for p in waiting if p[0] + reach <= now)
        left = sorted(p for p in waiting if p[0] + reach > now)
        kept = known[known["at"] + 2 * reach > now]
        if left or len(kept):
            state.update((kept.tobytes(), json.dumps(left)))
            end = left[0][0] + reach if left else int(kept["at"][-1]) + 2 * reach
            state.setTimeoutTimestamp(max(-(-end // 1000), now // 1000 + 1))
        elif state.exists:
            state.remove()
        if due:
            found, gap = _nearest_places(known, np.array([p[0] for p in due], dtype="i8"), reach)
            none = np.zeros(1, _PLACES)
            chosen = np.append(known, none)[found]
            answers = {"asked": [p[1] for p in due], "at": [p[0] for p in due]}
            measures = {c: chosen[c] for c in _PLACES.names[2:]} | {"gap_s": gap / 1e6}
            yield pd.DataFrame(answers | {c: np.where(found < 0, np.nan, v) for c, v in measures.items()})

    nearest = rows.groupBy("aircraft", "slot").applyInPandasWithState(
        step, _NEAREST, _WAITING, "append", GroupStateTimeout.EventTimeTimeout
    )
    asker = F.from_json("asked", StructType([probes.schema["seq"], probes.schema["icao"]]))
    return nearest.withColumns({"asked": asker, "time": F.timestamp_micros("at")}).select(
        "asked.*", "time", *_PLACES.names[2:], "gap_s"
    )


def storable() -> Column:
    """Rows the observation table accepts: known method, a time, finite measures."""
    ok = F.col("time").isNotNull() & F.col("method").isin(*S.METHODS)
    for name in ("altitude", "temperature", "distance"):
        ok = ok & finite(F.col(name))
    return F.coalesce(ok, F.lit(False))


def store_batch(good: DataFrame, bad: DataFrame, path: str, quarantine: str) -> None:
    """Append the good rows to the table; the others replace what the quarantine has of their batch."""
    append_observations(good, path)
    (
        bad.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(quarantine)
    )


#: Days before a batch whose stored rows are its history.
HISTORY_DAYS = 7


def _stored_days(
    spark: SparkSession, path: str, first: date | None, last: date | None = None
) -> DataFrame | None:
    """The stored table between two days, None while there is none."""
    stored = stored_table(spark, path)
    if stored is None:
        return None
    if first is not None:
        stored = stored.where(F.col("date") >= F.lit(first))
    return stored if last is None else stored.where(F.col("date") <= F.lit(last))


def _batch_days(batch: DataFrame) -> tuple[date | None, date | None]:
    """First and last day of a micro-batch: two values."""
    row = batch.agg(F.min(F.to_date("time")).alias("a"), F.max(F.to_date("time")).alias("b")).first()
    return row.a, row.b


def accept_batch(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    batch_id: int,
    history_days: int = HISTORY_DAYS,
    ring: HistoryRing | None = None,
) -> DataFrame:
    """Rows of a micro-batch that are no outliers against the history before it.

    The model is fitted once per batch, on the ring if there is one; else on the rows that
    earlier batches stored for the `history_days` before the first day of the batch, and for
    the days of the batch itself.
    """
    if ring is not None:
        history = ring.before(spark, batch_id)
    else:
        first, _last = _batch_days(batch)
        history = _stored_days(spark, path, None if first is None else first - timedelta(days=history_days))
        if history is not None and "batch_id" in history.columns:
            history = history.where(F.coalesce(F.col("batch_id") < batch_id, F.lit(True)))
    if history is None:
        history = batch.limit(0)
    flagged = outlier_flags(batch, usable_history(history))
    return flagged.where(~F.col("is_outlier")).select(batch.columns)


def _start(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool,
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def store_stream(
    observations: DataFrame,
    path: str,
    quarantine: str,
    checkpoint: str,
    available_now: bool = False,
    filter_outliers: bool = True,
    grids: dict[str, str] | None = None,
    ring: HistoryRing | None = None,
) -> StreamingQuery:
    """Observation stream → outlier check → observation table, quarantine, and grids.

    Rows carry their batch id: when a batch is repeated after a failure, rows it has
    put into the table already are left out, and those in the quarantine are replaced.
    With `grids` (paths by grid name), the stored cells take up the rows of a batch once it
    is stored.  With `ring`, outliers are judged by the latest accepted rows, and those of
    the batch join them.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        store_arrived(batch, batch_id, path, quarantine, filter_outliers, grids, ring)

    return _start(observations, each, checkpoint, available_now)


def store_arrived(
    batch: DataFrame,
    batch_id: int,
    path: str,
    quarantine: str,
    filter_outliers: bool = True,
    grids: dict[str, str] | None = None,
    ring: HistoryRing | None = None,
) -> None:
    """One micro-batch of `store_stream`; repeating it changes nothing.

    Verdicts rest on earlier batches alone, so a repeated batch accepts the same rows.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("batch_id", F.lit(batch_id))
    with discarded(spark):
        accepted = rows.where(storable())
        if filter_outliers:
            accepted = materialized(accept_batch(spark, accepted, path, batch_id, ring=ring), "accepted")
        if ring is not None:
            ring.accept(accepted, batch_id)
        good = _not_yet(accepted, _stored_days(spark, path, *_batch_days(rows)), batch_id)
        store_batch(good, rows.where(~storable()), path, quarantine)
        for spec in GRIDS if grids else ():
            merge_rows(storage_form(accepted), spec, grids[spec.name])


def _not_yet(rows: DataFrame, stored: DataFrame | None, batch_id: int) -> DataFrame:
    """Rows of a batch that an earlier, interrupted attempt has not stored yet.

    Rows without an id can't be told apart: they are stored if the batch has stored none.
    """
    if stored is None or "batch_id" not in stored.columns:
        return rows
    done = stored.where(F.col("batch_id") == batch_id).select(F.col("obs_id").alias("_done")).distinct()
    return rows.join(done, F.col("obs_id").eqNullSafe(F.col("_done")), "left_anti")


def grid_stream(
    stored: DataFrame,
    paths: dict[str, str],
    checkpoint: str,
    available_now: bool = False,
    every: str = "30 minutes",
) -> StreamingQuery:
    """Keep the grids in step with the observation table.

    `stored` is a stream of the table itself: rows join their cells after they are stored
    and not before.  Running a trigger twice gives the same grid; rows that are taken out
    of the table leave it by `refresh_days`.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with discarded(batch.sparkSession):
            for spec in GRIDS:
                merge_rows(storage_form(batch), spec, paths[spec.name])

    writer = stored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def refresh_days(spark: SparkSession, table: str, days: list[date], paths: dict[str, str]) -> None:
    """Recompute the grids of the given days from the stored table and replace just those days."""
    if days:
        rows = read_observations(spark, table).where(F.col("date").isin(days))
        for spec in GRIDS:
            replace_days(rows, spec, paths[spec.name], F.col("date").isin(days))
