"""Alarms for silent methods: once per silence, without input, and as a replay would raise them."""

import time
from datetime import datetime, timedelta

import pandas as pd

from skysonde.sources.storage import fresh_folder, stored_table
from skysonde.streaming.alarms import AbsenceAlarm, absence_alarms
from skysonde.streaming.positions import keyed_state

START = pd.Timestamp("2024-01-01")


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), []

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, second):
        self.ms = START.value // 1_000_000 + int(second * 1000)

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def alarm(by_clock=True):
    handle = Handle()
    processor = AbsenceAlarm({"mode-s": 60}, by_clock)
    processor.init(handle)

    def hear(*seconds):
        frame = pd.DataFrame({"time": [START + timedelta(seconds=s) for s in seconds]})
        return told(processor.handleInputRows(("mode-s",), iter([frame]), Clock(0)))

    def tick(second):
        return told(processor.handleExpiredTimer(("mode-s",), Clock(second), None))

    def told(frames):
        return [(t - START).total_seconds() for f in frames for t in f["last_received"]]

    return hear, tick, handle


def test_a_silence_is_told_once_and_ends_with_the_next_row():
    hear, tick, handle = alarm()
    assert hear(0, 30) == [] and handle.timers[-1] == Clock(90).ms + 1
    assert tick(90) == [] and tick(90.001) == [30] and tick(500) == []
    assert hear(600) == [] and tick(661) == [600]


def test_a_silence_between_rows_of_one_batch_is_told_too():
    hear, tick, _ = alarm(by_clock=False)
    assert hear(300, 60, 0, 121, 121) == [60, 121]
    assert hear(10) == [] and tick(360) == [] and tick(361) == [300]


def test_the_clock_raises_an_alarm_without_any_input(spark):
    landed, out = fresh_folder(spark, "land"), fresh_folder(spark, "out")
    schema = "method string, time timestamp"
    now = datetime.now()
    spark.createDataFrame([("vdl2", now), ("other", now)], schema).write.parquet(landed)
    since = spark.createDataFrame([("mode-s", now - timedelta(hours=1))], schema)
    stream = spark.readStream.schema(schema).parquet(landed)
    with keyed_state(spark):
        query = absence_alarms(stream, {"mode-s": 5, "vdl2": 15}, since).writeStream.option(
            "checkpointLocation", fresh_folder(spark, "mark")
        ).trigger(processingTime="2 seconds").format("parquet").start(out)
    try:
        for _ in range(90):
            time.sleep(1)
            table = stored_table(spark, out)
            raised = table.collect() if table else []
            if len(raised) == 2:
                break
    finally:
        query.stop()
    assert sorted(r.method for r in raised) == ["mode-s", "vdl2"]
    assert {r.method: (r.due - r.last_received).total_seconds() for r in raised} == {"mode-s": 5.0, "vdl2": 15.0}
