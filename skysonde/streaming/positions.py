"""Position history as stream state: what altitudes are filled from while messages come in.

State is kept per aircraft: its positions of the last two windows, the callsigns it was
heard under, and the weather rows that still wait for a nearer position.  A timer per
aircraft drops what falls out of the windows; an aircraft without positions loses its
callsigns too, so that state is bounded by the aircraft in the air.
"""

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skysonde import settings as S
from skysonde.functions.identifiers import normal_identifier

_ROWS = (
    "seq long, time timestamp, icao string, callsign string, altitude_m double, latitude double, "
    "longitude double, is_probe boolean"
)
_ANSWERS = "seq long, time timestamp, icao string, callsign string, altitude_m double, latitude double, longitude double, gap_s double"
#: Columns of the answers; a stream names them in this order.
ANSWER_COLUMNS = tuple(part.split()[0] for part in _ANSWERS.split(", "))
#: A callsign leads to its aircraft for so long after it was heard last.
CALLSIGN_TTL_S = 86_400
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Position(NamedTuple):
    at: int
    seq: int
    altitude_m: float | None
    latitude: float | None
    longitude: float | None
    since: int  # when the aircraft appeared that hasn't been gone for two windows since


class Name(NamedTuple):
    """A callsign of an appearance of an aircraft: when it began, heard the name, and was heard last."""

    callsign: str
    since: int
    heard: int
    until: int


class Probe(NamedTuple):
    at: int
    seq: int
    callsign: str | None
    named: bool


#: Columns of arriving rows, as `_arrived` gives them; the time comes first, in microseconds.
_ARRIVING = ("seq", "icao", "callsign", "altitude_m", "latitude", "longitude", "is_probe", "named")


def _arrived(frames: Iterable[pd.DataFrame]) -> list[tuple]:
    """Rows of one key as (at, *_ARRIVING), in order of time and message; columns they haven't are None."""
    rows = []
    for frame in frames:
        columns = [(frame["time"].to_numpy("datetime64[ns]").astype("int64") // 1000).tolist()]
        for name in _ARRIVING:
            values = frame[name].astype(object) if name in frame else pd.Series([None] * len(frame), dtype=object)
            columns.append(values.where(values.notna(), None).tolist())
        rows += zip(*columns)
    return sorted(rows, key=itemgetter(0, 1))


def nearest(positions: list[Position], times: list[int], at: int, reach: int) -> Position | None:
    """The position nearest in time within the reach, the later one (then the later message) on a tie.

    Positions are in order of time and message; `times` are theirs.
    """
    after = bisect_right(times, at)
    before = positions[after - 1] if after and at - times[after - 1] <= reach else None
    if after < len(times) and times[after] - at <= (at - before.at if before else reach):
        return positions[bisect_right(times, times[after], after) - 1]
    return before


class PositionBuffer(StatefulProcessor):
    """Positions of one aircraft, its callsigns, and the probes that wait."""

    def __init__(self, window_s: int) -> None:
        self.reach = window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.positions = handle.getListState(
            "positions", "at long, seq long, altitude_m double, latitude double, longitude double, since long"
        )
        self.callsigns = handle.getListState("callsigns", "callsign string, since long, heard long, until long")
        self.waiting = handle.getListState("waiting", "at long, seq long, callsign string, named boolean")

    def _held(self) -> tuple[list[Position], dict[tuple[str, int], Name], list[Probe]]:
        names = [Name(*n) for n in self.callsigns.get()]
        return [Position(*p) for p in self.positions.get()], {n[:2]: n for n in names}, [Probe(*p) for p in self.waiting.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        positions, names, waiting = self._held()
        last = max(positions, key=itemgetter(0, 1), default=None)
        heard: dict[int, int] = {}  # by appearance: the latest of its positions that came
        for at, seq, _icao, callsign, *place, is_probe, named in _arrived(rows):
            if is_probe:
                waiting.append(Probe(at, int(seq), callsign, bool(named)))
                continue
            since = at if last is None or at - last.at > 2 * self.reach else last.since
            position = Position(at, int(seq), *place, since)
            positions.append(position)
            last = position if last is None or position[:2] > last[:2] else last
            heard[since] = at
            if callsign and (callsign, since) not in names:
                names[callsign, since] = Name(callsign, since, at, at)
        for k, n in names.items():
            names[k] = n._replace(until=max(n.until, heard.get(n.since, n.until)))
        yield from self._settled(key, timerValues, positions, names, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues, *self._held())

    def _settled(self, key, timers, positions, names, waiting) -> Iterator[pd.DataFrame]:
        """Answer the probes whose window is over, drop what is old, and set the next timer."""
        now = timers.getCurrentWatermarkInMs() * 1000
        answers = []
        positions = sorted(positions, key=itemgetter(0, 1))
        times = [p.at for p in positions]
        for probe in sorted((p for p in waiting if p.at + self.reach <= now), key=itemgetter(0, 1)):
            found = nearest(positions, times, probe.at, self.reach)
            if found and probe.named:
                name = names.get((probe.callsign, found.since))
                found = found if name and name.heard <= probe.at else None
            place = found[2:5] if found else (None, None, None)
            gap = abs(found.at - probe.at) / 1e6 if found else None
            answers.append((probe.seq, pd.Timestamp(probe.at * 1000), key[0], probe.callsign, *place, gap))
        waiting = [p for p in waiting if p.at + self.reach > now]
        positions = positions[bisect_right(times, now - 2 * self.reach) :]
        self._keep(self.positions, positions)
        self._keep(self.callsigns, sorted(n for n in names.values() if n.until + 2 * self.reach > now))
        self._keep(self.waiting, waiting)
        ends = [p.at + self.reach for p in waiting] + [p.at + 2 * self.reach for p in positions[:1]]
        if ends:
            self.handle.registerTimer(-(-min(ends) // 1000))
        if answers:
            yield pd.DataFrame(answers, columns=ANSWER_COLUMNS)

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put([tuple(r) for r in rows])
        else:
            state.clear()

    def close(self) -> None:
        pass


class CallsignRouter(StatefulProcessor):
    """The aircraft that was last heard under one callsign; probes that name it get its address."""

    def __init__(self, ttl_s: int) -> None:
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.aircraft = handle.getValueState("aircraft", "at long, seq long, icao string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.aircraft.get()
        out = []
        for at, seq, heard_from, *_measures, is_probe, _named in _arrived(rows):
            if is_probe:
                icao = held[2] if held else f"?{key[0]}"
                out.append((int(seq), pd.Timestamp(at * 1000), icao, key[0], None, None, None, True))
            elif held is None or (at, int(seq)) >= tuple(held[:2]):
                held = (at, int(seq), heard_from)
        if held:
            self.aircraft.update(tuple(held))
            self.handle.registerTimer(held[0] // 1000 + self.ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=[part.split()[0] for part in _ROWS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.aircraft.get()
        if held and held[0] // 1000 + self.ttl_ms <= timerValues.getCurrentWatermarkInMs():
            self.aircraft.clear()
        return iter([])

    def close(self) -> None:
        pass


def _as_rows(df: DataFrame, is_probe: bool, lateness: str) -> DataFrame:
    """Positions or probes in one form; what a probe hasn't is NULL."""
    have = set(df.columns)
    measures = [
        (F.lit(None) if is_probe else F.col(c)).cast("double").alias(c) for c in ("altitude_m", "latitude", "longitude")
    ]
    name = normal_identifier(F.col("callsign")) if "callsign" in have else F.lit(None).cast("string")
    return df.select(
        F.col("seq").cast("long").alias("seq"),
        F.col("time").cast("timestamp").alias("time"),
        F.nullif(normal_identifier(F.col("icao")), F.lit("")).alias("icao"),
        F.nullif(name, F.lit("")).alias("callsign"),
        *measures,
        F.lit(is_probe).alias("is_probe"),
    ).withWatermark("time", lateness)


def _routed(rows: DataFrame) -> DataFrame:
    """Rows with the routes they take: by callsign, by address or both.

    A filter on a column of the input would be moved below the watermark, which then would
    wait for rows of that kind; the routes come out of a generator, so it sees all rows.
    """
    by_name = F.col("callsign").isNotNull() & (~F.col("is_probe") | F.col("icao").isNull())
    routes = F.array(F.when(by_name, "callsign"), F.when(F.col("icao").isNotNull(), "icao"))
    return rows.select("*", F.explode(F.array_compact(routes)).alias("route"))


def filled_from_history(
    positions: DataFrame,
    probes: DataFrame,
    window_s: int = S.POSITION_WINDOW_S,
    lateness: str = "10 seconds",
    callsign_ttl_s: int = CALLSIGN_TTL_S,
) -> DataFrame:
    """Weather rows of a stream, each with the nearest position within the window, from keyed state.

    Start it within `keyed_state`.  A probe (seq, time, icao, callsign) goes to its address; one without an address goes to
    the aircraft last heard under its callsign at that time, and finds something only where
    that aircraft had the name since it appeared.  Each is answered once the watermark is
    a window past it, with NULLs if nothing is in reach.  Positions are kept for two
    windows after the watermark, so none that a row in time could need is dropped; rows
    behind the watermark are left out, as everywhere in Structured Streaming.
    """
    rows = _routed(_as_rows(positions, False, lateness).unionByName(_as_rows(probes, True, lateness)))
    found = rows.where("route = 'callsign'").drop("route").groupBy("callsign").transformWithStateInPandas(
        CallsignRouter(callsign_ttl_s), _ROWS, "Append", "EventTime", eventTimeColumnName="time"
    )
    direct = rows.where("route = 'icao'").drop("route").withColumn("named", F.lit(False))
    return (
        direct.unionByName(found.withColumn("named", F.lit(True)))
        .groupBy("icao")
        .transformWithStateInPandas(PositionBuffer(window_s), _ANSWERS, "Append", "EventTime")
    )


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams started inside keep their state where processors of keyed state need it.

    `partitions` is how many tasks a new stream's state is dealt to; its checkpoint keeps
    that number.  A stream takes the session's settings when it starts, so others are left
    as they are.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS_DB}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def held_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """One state of a stopped `filled_from_history`: positions, callsigns, waiting or aircraft."""
    operator = 1 if name == "aircraft" else 0
    rows = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("operatorId", operator)
        .option("stateVarName", name)
        .load()
    )
    held = "value" if name == "aircraft" else "list_element"
    return rows.select("key.*", f"{held}.*")
