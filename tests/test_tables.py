"""Grids, medians, series, outliers, comparison and surface against plain computations."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysonde import bridge
from skysonde import settings as S
from skysonde.catalog import rounded
from skysonde.operators import (
    compare, filters, grid, medians, outliers, profile, series, surface, winds,
)
from skysonde.operators.topn import time_limited
from skysonde.plans import views
from skysonde.sources import tables
from skysonde.sources.storage import fresh_folder

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_refresh_equals_rebuild(spark):
    rows = bridge.observations(spark, SF)
    now = F.lit("2024-01-20 10:10:00").cast("timestamp")
    early = rows.where(F.col("time") < "2024-01-20 09:00:00")
    upto = rows.where(F.col("time") < "2024-01-20 10:10:00")
    for spec in grid.GRIDS:
        path, full = fresh_folder(spark, "grid"), fresh_folder(spark, "full")
        grid.rebuild_grid(early, spec, path)
        grid.refresh_grid(upto, spec, path, now)
        grid.rebuild_grid(upto, spec, full)
        kept, whole = grid.read_grid(spark, path), grid.read_grid(spark, full)
        assert kept.count() == whole.count() and kept.exceptAll(whole).count() == 0
        state = grid.refreshed_state(grid.representative_grid(early, spec), upto, spec, now)
        assert state.exceptAll(whole.drop("date")).count() == 0


def test_grid_rows_are_real_rows_and_ties_go_to_the_higher_id(spark):
    rows = bridge.observations(spark, SF)
    cells = grid.representative_grid(rows, grid.THREE_HOUR_GRID)
    assert cells.join(rows, ["time", "altitude", "temperature"], "left_anti").count() == 0
    twice = rows.unionByName(rows.withColumns({"obs_id": F.col("obs_id") + 5000, "wind_x": F.lit(99.0)}))
    tied = grid.representative_grid(twice, grid.THREE_HOUR_GRID)
    assert tied.where(F.col("wind_x") != 99.0).count() == 0
    assert "WindowGroupLimit" in plan_of(cells)


def test_one_grid_failing_does_not_stop_the_other(spark):
    rows = bridge.observations(spark, SF)
    paths = {"half_hour": "/proc/no-such-place/x", "three_hour": fresh_folder(spark, "ok")}
    done = grid.refresh_all(rows, paths, F.lit("2024-01-20").cast("timestamp"), rebuild=True)
    assert done == {"half_hour": False, "three_hour": True}


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    pairs = [(int(k), float(np.round(v, 1))) for k, v in zip(rng.integers(0, 4, n), rng.normal(0, 9, n))]
    df = spark.createDataFrame(pairs, "k int, v double")
    got = {r.k: r.v for r in medians.exact_median(df, "k", "v", 0.25).collect()}
    for k in {k for k, _v in pairs}:
        assert got[k] == pytest.approx(np.median([v for i, v in pairs if i == k]))


def loop_bins(times, temps, width):
    out, i = [], 0
    while i < len(times):
        j = i
        while j < len(times) and times[j] <= times[i] + width:
            j += 1
        out.append((times[i], j - i, sum(temps[i:j]) / (j - i)))
        i = j
    return out


def run_bins(spark, pairs, width, key="a"):
    df = spark.createDataFrame(
        [(key, T0 + timedelta(microseconds=t), float(v)) for t, v in pairs],
        "band string, time timestamp_ntz, temperature double")
    rows = series.anchored_bins(df, "band", "temperature", width=width).collect()
    return sorted((round((r.bin_start - T0).total_seconds() * 1e6), r.n, r.mean_temperature) for r in rows)


@pytest.mark.parametrize("seed", [0, 1, 42])
@pytest.mark.parametrize("span", [7 * 86_400_000_000, 30_000_000_000])
def test_bins_equal_the_plain_loop(spark, seed, span):
    rng = random.Random(seed)
    pairs = sorted((rng.randrange(span), rng.uniform(-60, 30)) for _ in range(500))
    expected = loop_bins([t for t, _ in pairs], [v for _, v in pairs], S.SERIES_BIN_MICROS)
    got = run_bins(spark, pairs, S.SERIES_BIN_MICROS)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])


def test_bin_edges_and_single_points(spark):
    assert [g[1:] for g in run_bins(spark, [(0, 0), (500_000, 10), (500_001, 20)], 500_000)] == [(2, 5), (1, 20)]
    assert run_bins(spark, [(0, 1)], 500_000) == []
    assert [g[1] for g in run_bins(spark, [(0, 1), (0, 2), (0, 3)], 500_000)] == [3]


def profile_history(spark, n=300):
    rng = np.random.default_rng(42)
    alt = np.round(rng.uniform(0, 12000, n))
    temp = 15 - 6.5 * alt / 1000 + rng.normal(0, 1.5, n)
    rows = [(i, T0 + timedelta(seconds=36 * i), float(a), float(t), "mode-s", "X", 10.0)
            for i, (a, t) in enumerate(zip(alt, temp))]
    schema = ("obs_id long, time timestamp_ntz, altitude double, temperature double, "
              "method string, callsign string, distance double")
    return spark.createDataFrame(rows, schema), alt, temp


def test_neighbours_equal_brute_force(spark):
    history, alt, temp = profile_history(spark)
    rng = np.random.default_rng(7)
    asked = np.concatenate([rng.uniform(-50, 14000, 60), alt[:20]])
    rows = spark.createDataFrame([(i, float(a)) for i, a in enumerate(asked)], "n int, altitude double")
    got = {r.n: r for r in outliers.neighbour_statistics(rows, history, 50).collect()}
    assert len(got) == len(asked)
    for i, a in enumerate(asked):
        gap = np.abs(alt - a)
        near = np.argsort(gap, kind="stable")[:50]
        if np.sort(gap)[49] == np.sort(gap)[50]:
            continue
        assert got[i].mean_temperature == pytest.approx(temp[near].mean())
        assert got[i].std_temperature == pytest.approx(temp[near].std())


def test_planted_outliers_are_found(spark):
    history, *_ = profile_history(spark)
    batch = history.limit(0).unionByName(spark.createDataFrame(
        [(900 + i, T0, a, t, "vdl2", "Y", 1.0) for i, (a, t) in enumerate(
            [(5000.0, 30.0), (5000.0, -50.0), (5000.0, -17.5), (8000.0, -37.0), (100.0, -99.0), (1.0, -150.0)])],
        history.schema))
    flags = {r.obs_id: r.is_outlier for r in outliers.outlier_flags(batch, history).collect()}
    assert flags == {900: True, 901: True, 902: False, 903: False, 904: True}
    few = outliers.outlier_flags(batch, history.limit(99)).where("is_outlier").count()
    assert few == 0


def test_discrepancies_meet_once_and_use_keys(spark):
    records = compare.comparison_records(bridge.observations(spark, "/root/testdata/sf0.01"))
    one = compare.discrepancies(records, window_s=3600)
    salted = compare.discrepancies(records, window_s=3600, step_records=3)
    ids = ["modes_obs_id", "vdl2_obs_id"]
    assert one.select(ids).distinct().count() == one.count() == salted.count() > 0
    assert one.select(ids).exceptAll(salted.select(ids)).count() == 0
    both = compare.discrepancies(records, window_s=3600, symmetric=True)
    assert both.count() > one.count()
    assert "NestedLoop" not in plan_of(one) and "Cartesian" not in plan_of(one)


def dense_records(spark):
    """Many records of one time and altitude step, with ids and times that repeat or are null."""
    i = F.col("id")
    seconds = F.when(i % 101 != 0, F.pmod(F.hash("id"), F.lit(3000)))
    return spark.range(3000).select(
        F.when(i % 50 != 0, i % 2500).alias("obs_id"),
        (F.lit(T0) + F.make_dt_interval(secs=seconds)).cast("timestamp_ntz").alias("time"),
        F.lit("FL1").alias("callsign"),
        F.when(i % 31 != 0, (i % 200).cast("double")).alias("altitude"),
        F.when(i % 7 != 0, (i % 40).cast("double")).alias("temperature"),
        (i % 30).cast("double").alias("wind_speed"),
        (i % 360).cast("double").alias("wind_angle"),
        F.when(i % 3 == 0, "vdl2").otherwise("modes").alias("source"),
    )


def test_a_dense_step_is_spread_over_tasks(spark):
    records = dense_records(spark)
    whole = compare.discrepancies(records, window_s=3600)
    spread = compare.discrepancies(records, window_s=3600, task_candidates=20_000)
    assert whole.count() == spread.count() > 100_000
    assert whole.exceptAll(spread).count() == 0
    tasks = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 20 and max(tasks) < 0.15 * sum(tasks)


def test_tasks_follow_the_candidates(spark):
    records = spark.range(400).crossJoin(spark.range(1600).withColumnRenamed("id", "step")).select(
        (F.col("step") * 400 + F.col("id")).alias("obs_id"),
        (F.lit(T0) + F.make_dt_interval(hours=F.col("step").cast("int") * 3, secs=F.col("id"))).cast("timestamp_ntz").alias("time"),
        F.lit("FL1").alias("callsign"), (F.col("id") % 50 + 1000).cast("double").alias("altitude"), F.lit(0.0).alias("temperature"),
        F.lit(0.0).alias("wind_speed"), (F.col("id") % 2 * 90).cast("double").alias("wind_angle"),
        F.when(F.col("id") % 2 == 0, "vdl2").otherwise("modes").alias("source"),
    )
    pairs = compare.discrepancies(records, window_s=3600)
    tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 1600 * 200 * 199 // 2
    assert len(tasks) > 8


def test_doubles_are_rounded_as_by_round(spark):
    rng = np.random.default_rng(3)
    ties = [k + h for k in range(-3, 4) for h in (0.0000005, 0.0000015, 0.1234565, 0.5, 1e-9 / 2, 3.5e-9)]
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, -1e-7, 1e-300, 1e300, -1e15, 999999.9999995, 1e6 + 0.1234565]
    values = ties + odd + list(map(float, rng.uniform(-200, 200, 5000))) + [float(round(x, 7)) for x in rng.uniform(-9, 9, 5000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for places in (6, 9):
        plain = F.round("v", places) + F.lit(0.0)
        kept = rows.select(rounded(F.col("v"), places).alias("got"), plain.alias("due"))
        assert kept.where(~F.col("got").eqNullSafe(F.col("due"))).count() == 0
        assert kept.where((F.col("got") == 0) & (F.col("got").cast("string") != "0.0")).count() == 0


def affine_rows(spark, n=4000):
    rng = np.random.default_rng(5)
    t, a = rng.uniform(0, 86400e6, n).astype("int64"), rng.uniform(0, 13000, n)
    rows = [(T0 + timedelta(microseconds=int(x)), float(y), float(20 - x / 86400e6 * 3 - 0.0065 * y))
            for x, y in zip(t, a)]
    return spark.createDataFrame(rows, "time timestamp_ntz, altitude double, temperature double")


def test_affine_field_is_reproduced_and_its_isotherms_lie_on_it(spark):
    rows = affine_rows(spark)
    extent = surface.mesh_extent(rows)
    mesh = surface.temperature_surface(rows, extent, nodes=20)
    first = extent.first()["first"] / 86400e6
    day0 = (T0 - datetime(1970, 1, 1)).days
    exact = 20 - (F.col("mesh_day") - day0) * 3 - 0.0065 * F.col("mesh_altitude")
    worst = mesh.agg(F.max(F.abs(F.col("value") - exact)).alias("e"), F.count("value").alias("n")).first()
    assert worst.e < 1e-6 and worst.n == 400 and first >= day0
    lines = surface.isotherms(mesh)
    on_line = 20 - (F.col("cross_day") - day0) * 3 - 0.0065 * F.col("cross_altitude") - F.col("level")
    assert lines.count() > 50
    assert lines.agg(F.max(F.abs(on_line)).alias("e")).first().e < 1e-6


def test_wind_field_and_hodograph(spark):
    rows = bridge.observations(spark, SF)
    for span, bins in ((1, 48), (2, 24), (10, None)):
        part = rows.where(F.col("time") < T0 + timedelta(days=span))
        top = winds.wind_field(part).agg(F.max("time_bin").alias("b")).first().b
        assert top == (bins or top) - 1 if bins else top >= 36
    points = profile.hodograph(filters.windy_rows(rows.where("altitude >= 0")))
    assert profile.hodograph_segments(points).count() == points.count() - 1


@pytest.mark.parametrize("latest", [False, True])
@pytest.mark.parametrize("n", [1, 10, 999, 5000])
def test_limited_rows_equal_sort_and_limit(spark, latest, n):
    rows = bridge.observations(spark, SF)
    order = [F.desc("time"), F.desc("obs_id")] if latest else ["time", "obs_id"]
    expected = [r.obs_id for r in rows.orderBy(*order).limit(n).collect()]
    assert [r.obs_id for r in time_limited(rows, n, latest).collect()] == expected


def test_filters_and_columns_reach_the_scan(spark):
    path = fresh_folder(spark, "stored")
    tables.append_observations(bridge.observations(spark, SF), path)
    stored = tables.read_observations(spark, path)
    rows = filters.quality_rows(stored.where(F.col("date") == "2024-01-05"), F.lit("2024-01-05").cast("timestamp_ntz"))
    scan = plan_of(rows.select("time", "altitude", "temperature"))
    ranged = plan_of(filters.quality_rows(stored, F.lit("2024-01-05").cast("timestamp_ntz")))
    assert "date" in ranged.split("PartitionFilters: [")[1].split("]")[0]
    assert "PartitionFilters: [isnotnull(date" in scan
    assert "LessThanOrEqual(distance,100.0)" in scan
    assert "callsign" not in scan.split("ReadSchema")[1]


def test_short_views_read_raw_rows_and_all_views_run(spark):
    request = views.Request(bridge.observations(spark, SF), datetime(2024, 1, 3), datetime(2024, 1, 9))
    raw = filters.quality_rows(
        request.observations, F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz"))
    assert views.view("scatter_2d", request).count() == raw.count()
    for name in views.VIEWS:
        assert views.view(name, request).columns
    limited = views.Request(request.observations, request.start, request.end, limited=True)
    assert views.view("density", limited).agg(F.max("altitude")).first()[0] <= 2000


def test_raw_table_is_not_read_when_the_grid_serves(spark):
    from skysonde.operators import fetch

    rows = bridge.observations(spark, SF)
    path = fresh_folder(spark, "raw")
    tables.append_observations(rows, path)
    stored = tables.read_observations(spark, path)
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-02", "2024-01-20"))
    half = grid.representative_grid(rows, grid.HALF_HOUR_GRID)
    served = fetch.grid_or_raw(half, stored, start, end)
    assert served.count() == fetch.fetch_grid_measures(half, start, end).count() > 0
    scans = [part.split("]")[0] for part in plan_of(served).split("PartitionFilters: [")[1:]]
    assert any("date" in scan and "Subquery" in scan for scan in scans)
    empty = fetch.grid_or_raw(half.limit(0), stored, start, end)
    assert empty.count() == filters.quality_rows(rows, start, end).count() > 0
    assert fetch.grid_or_raw(None, stored, start, end).count() == empty.count()


def test_naive_times_become_instants_once(spark):
    naive = spark.createDataFrame([(datetime(2024, 1, 1, 9),)], "time timestamp_ntz")
    zoned = tables.naive_to_zoned(naive)
    assert str(zoned.select(F.col("time").cast("string")).first()[0]) == "2024-01-01 00:00:00"
    assert tables.naive_to_zoned(zoned).collect() == zoned.collect()


def test_missing_grid_is_flagged(spark):
    from skysonde.operators import monitor

    half = grid.representative_grid(bridge.observations(spark, SF), grid.HALF_HOUR_GRID)
    stats = {r.grid: r for r in monitor.grid_statistics({"half_hour": half, "three_hour": None}).collect()}
    assert stats["three_hour"].error and stats["three_hour"].row_count == 0
    assert not stats["half_hour"].error and stats["half_hour"].row_count > 0


def test_exports_are_read_back_whole(spark):
    from skysonde.sources import exports
    from skysonde.sources.storage import fresh_folder

    records = compare.comparison_records(bridge.observations(spark, SF)).withColumn(
        "temperature", F.when(F.col("obs_id") != 3, F.col("temperature")))
    path = fresh_folder(spark, "csv")
    exports.write_comparison_csv(records, path)
    back = spark.read.csv(path, header=True)
    assert back.count() == records.count() and back.where("altitude_m = 'n' OR temperature_c = 'n'").count() == 0
    assert back.where("temperature_c IS NULL").count() == records.where("temperature IS NULL").count() > 0
    pairs = compare.discrepancies(records, window_s=3600)
    exports.write_discrepancies_json(pairs, path)
    schema = exports.discrepancy_documents(pairs).schema
    docs = spark.read.schema(schema).options(**exports.JSON_TIMES).json(path)
    assert docs.exceptAll(exports.discrepancy_documents(pairs)).count() == 0 and docs.count() == pairs.count()


def test_numbering_and_latest_values_over_blocks(spark):
    from skysonde.operators.ranges import numbered, with_latest

    rows = spark.range(500).selectExpr("id", "(id * 37) % 100 AS v", "IF(id % 7 = 0, id, NULL) AS mark")
    data = sorted([(r.v, r.id, r.mark) for r in rows.collect()], key=lambda r: r[:2])
    got = {r.id: r._at for r in numbered(rows, "v", "id").collect()}
    assert got == {r[1]: n + 1 for n, r in enumerate(data)}
    latest, expected = None, {}
    for _v, i, mark in data:
        latest = latest if mark is None else mark
        expected[i] = latest
    assert {r.id: r.mark for r in with_latest(rows, "mark", "v", "id").collect()} == expected


def test_discrepancies_are_stored_compressed(spark):
    import os

    from skysonde.operators import compare
    from skysonde.sources import exports

    records = compare.comparison_records(bridge.observations(spark, SF))
    pairs = compare.discrepancies(records, window_s=36_000)
    path = fresh_folder(spark, "json")
    exports.write_discrepancies_json(pairs, path)
    files = [n for n in os.listdir(path) if n.startswith("part-")]
    plain = exports.discrepancy_documents(pairs).select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.sum("n")).first()[0]
    assert files and all(n.endswith(".json.gz") for n in files)
    assert sum(os.path.getsize(f"{path}/{n}") for n in files) < 0.5 * plain


def test_tiles_hold_the_same_pairs(spark):
    records = dense_records(spark).where(F.col("altitude").isNull() | (F.col("altitude") < 40)).localCheckpoint()
    whole = compare.discrepancies(records, window_s=3600)
    for limits in ({"task_candidates": 4_000}, {"step_records": 100, "symmetric": True}):
        plain = compare.discrepancies(records, window_s=3600, **limits)
        tiled = compare.discrepancies(records, window_s=3600, tile=7, **limits)
        assert tiled.columns == whole.columns and tiled.count() == plain.count() > 10_000
        assert tiled.exceptAll(plain).count() == 0
    assert compare.discrepancies(records.where("source = 'modes'"), window_s=3600, tile=7).count() == 0


def test_documents_of_a_dense_hour_take_few_bytes(spark, tmp_path):
    import glob
    import os

    from skysonde.catalog import QUERIES

    rng = np.random.default_rng(7)
    n = 5000
    seconds, values = rng.uniform(0, 3600, n), rng.uniform(0, 100, n)
    kinds = ("error", "signup", "view", "click", "purchase")
    spark.createDataFrame(
        [(i, T0 + timedelta(seconds=float(seconds[i])), i % 301, kinds[rng.integers(5)], float(values[i]), "{}") for i in range(n)],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stored = f"{spark.conf.get('spark.checkpoint.dir')}/skysonde-discrepancies-*"
    before = set(glob.glob(stored))
    rows = QUERIES["s6_discrepancy_json"](spark, str(tmp_path)).count()
    (path,) = set(glob.glob(stored)) - before
    size = sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))
    assert rows > 100_000 and size / rows < 66
