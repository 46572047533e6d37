"""The position history as keyed state: windows, ties, names and timers, without and with a stream."""

import time
from datetime import datetime, timedelta

import pandas as pd

from skysonde.streaming import positions as history
from skysonde.sources.storage import fresh_folder

START = pd.Timestamp("2024-01-01")


class Listed:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        assert rows
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Handle:
    """State and timers of one key, kept in lists."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, Listed())

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, second):
        self.ms = (START.value // 1_000_000) + int(second * 1000)

    def getCurrentWatermarkInMs(self):
        return self.ms


def buffer(window=60):
    handle = Handle()
    processor = history.PositionBuffer(window)
    processor.init(handle)
    return processor, handle


def feed(processor, rows, watermark):
    """Rows (second, seq, altitude or None for a probe, callsign); answers as {seq: altitude}."""
    frame = pd.DataFrame(
        [
            {
                "seq": seq, "time": START + timedelta(seconds=second), "icao": "A", "callsign": name, "altitude_m": altitude,
                "latitude": None, "longitude": None, "is_probe": altitude is None, "named": altitude is None and name is not None,
            }
            for second, seq, altitude, name in rows
        ]
    )
    out = [f for f in processor.handleInputRows(("A",), iter([frame]), Clock(watermark))]
    return {r.seq: _value(r.altitude_m) for f in out for r in f.itertuples()}


def tick(processor, watermark):
    out = list(processor.handleExpiredTimer(("A",), Clock(watermark), None))
    return {r.seq: _value(r.altitude_m) for f in out for r in f.itertuples()}


def _value(x):
    return None if pd.isna(x) else x


def test_the_nearest_position_wins_and_the_later_one_on_a_tie():
    processor, _ = buffer()
    assert feed(processor, [(0, 1, 10.0, None), (40, 2, 20.0, None), (20, 3, None, None), (15, 4, None, None), (101, 5, None, None)], 0) == {}
    assert tick(processor, 81) == {3: 20.0, 4: 10.0}
    assert tick(processor, 161) == {5: None}  # 61 seconds off


def test_answers_wait_for_the_window_and_state_goes_when_it_is_over():
    processor, handle = buffer()
    feed(processor, [(0, 1, 10.0, "X"), (30, 2, None, None)], 0)
    assert min(handle.timers) == Clock(90).ms
    assert tick(processor, 89) == {}
    assert tick(processor, 90) == {2: 10.0}
    assert [p[1] for p in handle.states["positions"].rows] == [1] and handle.timers[-1] == Clock(120).ms
    tick(processor, 120)
    assert not handle.states["positions"].rows and not handle.states["callsigns"].rows


def test_an_evicted_position_is_not_found():
    processor, _ = buffer()
    feed(processor, [(0, 1, 10.0, None)], 0)
    tick(processor, 121)
    feed(processor, [(50, 2, None, None)], 121)
    assert tick(processor, 122) == {} and feed(processor, [(200, 3, 5.0, None)], 122) == {}
    assert feed(buffer()[0], [(50, 2, None, None)], 121) == {2: None}


def test_a_name_serves_the_appearance_it_was_heard_in():
    processor, handle = buffer()
    rows = [(0, 1, 10.0, "X"), (50, 2, 20.0, None), (60, 3, None, "X"), (400, 4, 30.0, "Y"), (410, 5, None, "X"), (410, 6, None, "Y")]
    feed(processor, rows, 0)
    assert tick(processor, 470) == {3: 20.0, 5: None, 6: 30.0}
    assert [n[0] for n in handle.states["callsigns"].rows] == ["Y"]
    assert feed(processor, [(395, 7, None, "Y")], 470) == {7: None}  # asked before the name was heard


def test_a_stream_answers_by_address_and_by_callsign(spark):
    def landed(rows, schema):
        path = fresh_folder(spark, "land")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    places = [(1, at(0), "a1", "fl1 ", 100.0, 35.0, 139.0), (2, at(50), " A1", None, 200.0, 35.0, 139.0), (3, at(9000), "zz", None, 1.0, 0.0, 0.0)]
    asked = [(4, at(45), "A1", None), (5, at(40), None, "FL1"), (6, at(40), None, "NONE"), (7, at(40), None, None), (8, at(9000), "zz", None)]
    found = history.filled_from_history(
        landed(places, "seq long, time timestamp, icao string, callsign string, altitude_m double, latitude double, longitude double"),
        landed(asked, "seq long, time timestamp, icao string, callsign string"),
    )
    out, mark = fresh_folder(spark, "out"), fresh_folder(spark, "mark")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with history.keyed_state(spark):
        query = found.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").start(out)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert query.awaitTermination(120)
    answers = {r.seq: (r.altitude_m, r.gap_s) for r in spark.read.parquet(out).collect()}
    assert answers == {4: (200.0, 5.0), 5: (200.0, 10.0), 6: (None, None)}
    assert [r.seq for r in history.held_state(spark, mark, "positions").collect()] == [3]
    assert [r.icao for r in history.held_state(spark, mark, "aircraft").collect()] == ["A1"]
    assert [r.seq for r in history.held_state(spark, mark, "waiting").collect()] == [8]


def test_a_busy_aircraft_takes_no_longer_for_each_row():
    processor, _ = buffer(1000)
    rows = [(n / 10, n, float(n), f"N{n % 100}") for n in range(10_000)] + [(n / 2 + 0.31, 20_000 + n, None, None) for n in range(2000)]
    began = time.process_time()
    feed(processor, rows, 0)
    answers = tick(processor, 3000)
    assert time.process_time() - began < 3
    assert len(answers) == 2000
    for seq, altitude in list(answers.items())[::50]:
        asked = (seq - 20_000) / 2 + 0.31
        assert altitude == min(range(10_000), key=lambda n: abs(n / 10 - asked))
