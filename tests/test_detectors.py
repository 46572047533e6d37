"""Detectors against a plain one that judges and learns row by row."""

from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from skysonde import catalog
from skysonde.operators import detectors
from skysonde.operators.detectors import Detector, Rule, outliers_in_arrival_order, outliers_in_order
from skysonde.sources.storage import fresh_folder

RULE = Rule(size=400, refit=50, least=100, k=60)


def plain(altitudes, temperatures, rule, known=()):
    history, added, model, out = deque(known, maxlen=rule.size), len(known), None, []
    for a, t in zip(altitudes, temperatures):
        verdict = False
        if len(history) >= rule.least:
            if model is None or added >= rule.refit:
                rows = np.array(history)
                slope, intercept = np.polyfit(rows[:, 0], rows[:, 1], 1)
                model, added = (slope, intercept, rows[np.argsort(rows[:, 0], kind="stable")]), 0
            slope, intercept, rows = model
            if abs(t - (slope * a + intercept)) > rule.tolerance:
                first = sum(x + y < 2 * a for x, y in zip(rows[: -rule.k, 0], rows[rule.k :, 0]))
                near = rows[first : first + rule.k, 1]
                gap, std = abs(t - near.mean()), near.std()
                verdict = gap > rule.deviation or (std > 0 and gap / std > rule.sigma)
        out.append(bool(verdict))
        if not verdict:
            history.append((a, t))
            added += 1
    return out


def measured(seed, n):
    rng = np.random.default_rng(seed)
    altitudes = rng.integers(0, 1200, n) * 10.0  # with ties
    temperatures = 15 - 0.0065 * altitudes + rng.normal(0, 2, n) + np.linspace(0, 12, n)  # it warms up
    wild = rng.random(n) < 0.05
    return altitudes, temperatures + wild * rng.choice([-40.0, 15.0, 30.0], n)


@pytest.mark.parametrize("seed, n", [(0, 99), (1, 101), (2, 1500), (3, 3000)])
def test_verdicts_equal_those_of_a_plain_detector(seed, n):
    altitudes, temperatures = measured(seed, n)
    expected = plain(altitudes, temperatures, RULE)
    assert Detector(RULE).judged(altitudes, temperatures).tolist() == expected
    assert n < 200 or any(expected)


@pytest.mark.parametrize("step", [1, 37, 500])
def test_a_detector_goes_on_where_it_was_stored(step):
    altitudes, temperatures = measured(4, 1200)
    got, state = [], None
    for at in range(0, 1200, step):
        detector = Detector.restored(RULE, state) if state else Detector(RULE)
        got += detector.judged(altitudes[at : at + step], temperatures[at : at + step]).tolist()
        state = detector.stored()
    assert got == plain(altitudes, temperatures, RULE)
    assert len(state[0]) <= 8 * (RULE.size + RULE.refit)


def test_equal_altitudes_give_a_level_line():
    verdicts = Detector(RULE).judged(np.full(150, 500.0), np.append(np.full(149, 10.0), 60.0))
    assert verdicts.tolist() == [False] * 149 + [True]


def frame(spark, parts, known=False):
    at = datetime(2024, 1, 1)
    rows = []
    for site, (altitudes, temperatures) in parts.items():
        rows += [
            (site * 10_000 + i, at + timedelta(seconds=i - 100_000 * known), site, float(a), float(t))
            for i, (a, t) in enumerate(zip(altitudes, temperatures))
        ]
    rows += [(-1, at, 1, None, 5.0), (-2, at, 1, 5.0, None), (-3, at, 1, 5.0, -150.0), (-4, None, 1, 5.0, 5.0)]
    return spark.createDataFrame(rows, "obs_id long, time timestamp, site int, altitude double, temperature double").repartition(5)


def test_batches_and_streams_have_a_detector_per_key(spark):
    parts = {1: measured(5, 700), 2: measured(6, 300)}
    rows = frame(spark, parts)
    expected = {}
    for site, (altitudes, temperatures) in parts.items():
        expected |= dict(zip(range(site * 10_000, site * 10_000 + len(altitudes)), plain(altitudes, temperatures, RULE)))
    got = outliers_in_order(rows, ["site"], rule=RULE)
    assert got.columns == [*rows.columns, "is_outlier"]
    assert {r.obs_id: r.is_outlier for r in got.collect()} == expected
    landed, out = fresh_folder(spark, "land"), fresh_folder(spark, "out")
    for early in (True, False):
        part = rows.where((rows.time < datetime(2024, 1, 1, 0, 5)) == early)
        part.coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    judged = outliers_in_arrival_order(stream, ["site"], RULE)
    query = judged.writeStream.option("checkpointLocation", fresh_folder(spark, "mark")).trigger(availableNow=True).format("parquet").start(out)
    assert query.awaitTermination(120)
    assert {r.obs_id: r.is_outlier for r in spark.read.parquet(out).collect()} == expected


def test_a_history_given_beforehand_is_learnt_and_not_judged(spark):
    past, now = measured(7, 260), measured(8, 200)
    got = outliers_in_order(frame(spark, {1: now}), ["site"], history=frame(spark, {1: past}, known=True), rule=RULE)
    expected = plain(*now, RULE, known=list(zip(*past)))
    assert [r.is_outlier for r in got.orderBy("obs_id").collect()] == expected and any(expected)


def test_no_rows(spark):
    rows = frame(spark, {}).where("obs_id < 0")
    assert outliers_in_order(rows, rule=RULE).collect() == []


def test_only_what_a_detector_reads_is_sorted(spark):
    plan = catalog.QUERIES["a17_outliers_in_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "temperature" in plan and "wind_x" not in plan and "longitude" not in plan


def test_a_micro_batch_is_held_packed(spark, monkeypatch):
    rows = pd.DataFrame({"obs_id": range(5000), "method": [f"mode-{n}" for n in range(5000)]})
    assert detectors._packed(rows).nbytes < 0.6 * rows.memory_usage(deep=True).sum()
    seen = []
    monkeypatch.setattr(catalog.detectors, "outliers_in_arrival_order", lambda stream, *_: seen.append(stream.columns) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalog.QUERIES["st5_refit_stream"](spark, "/root/testdata/sf0.001")
    assert seen == [["obs_id", "time", "altitude", "temperature", "method"]]
