"""Alarms for reception methods that went silent, raised by timers and not by rows."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skysonde import settings as S

#: Seconds of silence that are too many, per method.
LIMITS = {S.MODE_S: S.STALE_MODE_S_S, S.VDL2: S.STALE_VDL2_S}
_ALARMS = "method string, last_received timestamp, due timestamp"


class AbsenceAlarm(StatefulProcessor):
    """When one method was heard last, and whether its silence since has been told."""

    def __init__(self, limits: dict[str, int], by_clock: bool) -> None:
        self.limits, self.by_clock = limits, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "at long, told boolean")

    def _limit(self, key: tuple) -> int:
        return self.limits[key[0]] * 1_000_000

    def _wait(self, key: tuple, at: int) -> None:
        self.handle.registerTimer((at + self._limit(key)) // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        at = max(t.value // 1000 for t in initialState["time"])
        self.heard.update((at, False))
        self._wait(key, at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.heard.get()
        at, told = held if held else (None, False)
        silences = []
        for now in sorted(t.value // 1000 for frame in rows for t in frame["time"]):
            if at is None or now > at:
                if at is not None and not told and now - at > self._limit(key):
                    silences.append(at)  # it ended before its timer was looked at
                at, told = now, False
        self.heard.update((at, told))
        if not told:
            self._wait(key, at)
        yield from self._alarms(key, silences)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        at, told = self.heard.get()
        if told:
            return
        if now * 1000 - at > self._limit(key):
            self.heard.update((at, True))
            yield from self._alarms(key, [at])
        else:  # heard since the timer was set
            self._wait(key, at)

    def _alarms(self, key: tuple, silences: list[int]) -> Iterator[pd.DataFrame]:
        if silences:
            last = pd.to_datetime(pd.Series(silences), unit="us")
            due = pd.to_datetime(pd.Series([at + self._limit(key) for at in silences]), unit="us")
            yield pd.DataFrame({"method": key[0], "last_received": last, "due": due})

    def close(self) -> None:
        pass


def absence_alarms(
    observations: DataFrame,
    limits: dict[str, int] | None = None,
    since: DataFrame | None = None,
    by_clock: bool = True,
    lateness: str = "10 seconds",
) -> DataFrame:
    """(method, last_received, due) once per silence of a method that is longer than its limit.

    By the clock, an alarm comes when its time has come, whether or not anything arrives;
    `since` (method, time) starts the wait of methods that were never heard by this stream.
    Otherwise time is what the stream's watermark says, so that a replay raises what the
    live stream would have raised.  Methods without a limit are left out.  Start it within
    `positions.keyed_state`.
    """
    limits = LIMITS if limits is None else limits
    rows = observations.where(F.col("method").isin(*limits)).select("method", F.col("time").cast("timestamp").alias("time"))
    if not by_clock:
        rows = rows.withWatermark("time", lateness)
    first = None
    if since is not None:
        first = since.where(F.col("method").isin(*limits)).select("method", F.col("time").cast("timestamp").alias("time")).groupBy("method")
    return rows.groupBy("method").transformWithStateInPandas(
        AbsenceAlarm(limits, by_clock), _ALARMS, "Append", "ProcessingTime" if by_clock else "EventTime", initialState=first
    )
