"""Streams give what the batch operators give on the same input."""

import os
import tracemalloc

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from skysonde import bridge, catalog
from skysonde.operators import asof, grid
from skysonde.sources import landing, messages, tables
from skysonde.sources.storage import fresh_folder, shared_folder
from skysonde.streaming import fragments, jobs
from skysonde.streaming.ring import HistoryRing

SF = "/root/testdata/sf0.001"


def land(spark, frame, column="time", parts=3):
    path = fresh_folder(spark, "land")
    frame.withColumn(column, F.col(column).cast("timestamp")).repartition(parts).write.parquet(path)
    return path


def drain(spark, frame):
    out = fresh_folder(spark, "out")
    query = (
        frame.writeStream.option("checkpointLocation", fresh_folder(spark, "mark"))
        .trigger(availableNow=True).format("parquet").start(out)
    )
    assert query.awaitTermination(90)
    return spark.read.schema(frame.schema).parquet(out)


def test_live_pairing_follows_the_fold(spark):
    rows = bridge.modes_messages(spark, SF)
    stream = landing.stream_modes_messages(spark, land(spark, rows))
    got = drain(spark, fragments.live_pairs(stream, ttl_s=864_000)).select("seq", "data_source")
    expected = []
    for _icao, part in fragments.fragment_updates(rows).toPandas().groupby("icao"):
        out, _left, _seen = fragments.pair_fragments(
            part, dict.fromkeys(fragments._FIELDS), None, 864_000)
        expected += [(r["seq"], r["data_source"]) for r in out]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected) and expected


def test_xid_stream_equals_batch(spark):
    lines = bridge.vdl2_lines(spark, "/root/testdata/sf0.01")
    docs = messages.parse_datalink(lines)
    batch = asof.xid_fill(messages.acars_reports(docs), messages.xid_reports(docs), 21_600)
    live = messages.parse_datalink(
        landing.stream_datalink_lines(spark, land(spark, lines, "received_at")))
    stream = fragments.fragment_stream(
        messages.acars_reports(live), messages.xid_reports(live), 21_600, 43_200)
    got = drain(spark, stream)
    assert sorted((r.seq, r.altitude_ft) for r in got.collect()) == sorted(
        (r.seq, r.xid.altitude_ft) for r in batch.collect())
    assert fragments.fragment_observations(got).count() == batch.count() > 0


def test_nearest_position_stream_equals_batch_up_to_the_watermark(spark):
    places = bridge.positions(spark, SF)
    probes = bridge.probes(spark, SF)
    batch = asof.nearest_by_time(probes, places, window_s=7200).where("match IS NOT NULL")
    expected = {r.seq: r.match.altitude_m for r in batch.collect()}

    def stream(path):
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    found = jobs.nearest_position_stream(
        stream(land(spark, probes)), stream(land(spark, places)), 7200)
    got = {r.seq: r.altitude_m for r in drain(spark, found).collect()}
    assert got and all(expected.get(k) == v for k, v in got.items())
    assert None in got.values()
    assert sum(v is not None for v in got.values()) >= len(expected) - 5


def test_storing_filters_and_quarantines_once(spark):
    rows = bridge.observations(spark, SF)
    source = landing.stream_observations(spark, land(spark, rows), 1)
    path, bad = fresh_folder(spark, "table"), fresh_folder(spark, "bad")
    query = jobs.store_stream(source, path, bad, fresh_folder(spark, "mark"), available_now=True)
    assert query.awaitTermination(120)
    stored = tables.read_observations(spark, path)
    assert stored.select("obs_id").distinct().count() == stored.count()
    broken = rows.where("altitude IS NULL OR temperature IS NULL").count()
    assert spark.read.parquet(bad).count() == broken
    assert 0.8 * rows.count() < stored.count() <= rows.count() - broken


def test_grid_upkeep_equals_rebuild(spark):
    rows = bridge.observations(spark, SF).withColumn("time", F.col("time").cast("timestamp"))
    table = fresh_folder(spark, "table")
    tables.append_observations(rows.where("altitude IS NOT NULL"), table)
    paths = {spec.name: fresh_folder(spark, spec.name) for spec in grid.GRIDS}
    source = landing.stream_observations(spark, land(spark, rows), 1)
    query = jobs.grid_stream(source, paths, fresh_folder(spark, "mark"), available_now=True)
    assert query.awaitTermination(120)
    for spec in grid.GRIDS:
        kept = grid.read_grid(spark, paths[spec.name]).drop("date")
        whole = grid.representative_grid(tables.read_observations(spark, table), spec)
        assert kept.count() == whole.count() and kept.exceptAll(whole).count() == 0


def test_a_repeated_batch_stores_nothing_twice(spark):
    rows = bridge.observations(spark, SF).withColumn("time", F.col("time").cast("timestamp"))
    path, bad = fresh_folder(spark, "table"), fresh_folder(spark, "bad")
    paths = {spec.name: fresh_folder(spark, spec.name) for spec in grid.GRIDS}
    for _ in range(2):
        jobs.store_arrived(rows, 7, path, bad, filter_outliers=False, grids=paths)
    broken = rows.where("altitude IS NULL OR temperature IS NULL").count()
    assert spark.read.parquet(bad).count() == broken > 0
    assert tables.read_observations(spark, path).count() == rows.count() - broken
    assert grid.read_grid(spark, paths["half_hour"]).count() == grid.representative_grid(
        rows, grid.HALF_HOUR_GRID).count()


def test_an_emptied_day_leaves_the_grid(spark):
    rows = bridge.observations(spark, SF).withColumn("time", F.col("time").cast("timestamp"))
    path = fresh_folder(spark, "grid")
    grid.rebuild_grid(rows, grid.HALF_HOUR_GRID, path)
    last = rows.agg(F.max(F.to_date("time"))).first()[0]
    left = rows.where(F.to_date("time") < F.lit(last) - F.expr("INTERVAL 1 DAY"))
    now = F.lit(last).cast("timestamp")
    assert grid.read_grid(spark, path).where(F.to_date("time") >= F.lit(last)).count() > 0
    grid.refresh_grid(left, grid.THREE_HOUR_GRID, path, now)
    first_kept = F.to_date(grid.refresh_start(grid.THREE_HOUR_GRID, now))
    stale = grid.read_grid(spark, path).where(F.to_date("time_bucket") >= first_kept)
    assert stale.where(F.col("time") > left.agg(F.max("time")).first()[0]).count() == 0


def folders(spark):
    return set(os.listdir(shared_folder(spark)))


def test_a_repeated_batch_is_judged_as_before_and_leaves_no_tables(spark):
    rows = bridge.observations(spark, "/root/testdata/sf0.01").withColumn("time", F.col("time").cast("timestamp"))
    rows = rows.withColumn("obs_id", F.when(F.col("obs_id") % 500 != 0, F.col("obs_id")))
    half = F.lit("2024-01-15").cast("timestamp")
    table, bad = fresh_folder(spark, "table"), fresh_folder(spark, "bad")
    paths = {spec.name: fresh_folder(spark, spec.name) for spec in grid.GRIDS}
    ring = HistoryRing(fresh_folder(spark, "ring"), size=500, compact_after=2)

    def arrive(part, batch_id):
        jobs.store_arrived(part, batch_id, table, bad, grids=paths, ring=ring)
        kept = sorted(tables.read_observations(spark, table).select("time", "temperature").collect())
        cells = sorted(grid.read_grid(spark, paths["half_hour"]).select("time_bucket", "altitude_bin", "time").collect())
        return kept, cells, sorted(ring.rows(spark).collect(), key=lambda r: (r.time, r.temperature))

    once = arrive(rows.where(F.col("time") < half), 0)
    late = rows.where(F.col("time") >= half)
    # the last attempt broke off after the table was written
    done = arrive(late, 1)
    held = folders(spark)
    assert arrive(late, 1) == done and folders(spark) == held
    assert len(once[0]) < len(done[0]) < rows.where("altitude IS NOT NULL AND temperature IS NOT NULL").count()
    assert len(done[2]) == 500
    whole = grid.representative_grid(tables.read_observations(spark, table), grid.HALF_HOUR_GRID)
    assert len(done[1]) == whole.count()


def test_the_ring_holds_the_latest_rows_however_batches_come(spark):
    rows = bridge.observations(spark, SF).withColumn("time", F.col("time").cast("timestamp")).where(
        "altitude IS NOT NULL AND temperature > -100"
    )
    ring = HistoryRing(fresh_folder(spark, "ring"), size=90, compact_after=3)
    assert ring.rows(spark) is None
    parts = [rows.where(F.pmod(F.xxhash64("obs_id"), F.lit(8)) == n) for n in range(8)]
    for n, part in enumerate(parts):
        ring.accept(part, n)
        ring.accept(part, n)
    expected = [r.obs_id for r in rows.orderBy(F.desc("time"), F.desc("obs_id")).limit(90).collect()]
    assert [r.obs_id for r in ring.rows(spark).orderBy(F.desc("time"), F.desc("obs_id")).collect()] == expected
    before = parts[0].unionByName(parts[1])
    assert {r.obs_id for r in HistoryRing.before(ring, spark, 99).collect()} == set(expected)
    stored = spark.read.parquet(ring.path).select("kind", "batch").distinct().collect()
    assert {(r.kind, r.batch) for r in stored} == {("whole", 5), ("part", 6), ("part", 7)} and before.count()
    ring.accept(rows.limit(0), 8)
    assert [r.obs_id for r in ring.rows(spark).orderBy(F.desc("time"), F.desc("obs_id")).collect()] == expected


def test_merging_into_a_grid_reads_touched_days_only_and_repeats_safely(spark):
    rows = bridge.observations(spark, SF)
    path = fresh_folder(spark, "grid")
    for part in (rows.where("obs_id % 3 = 0"), rows.where("obs_id % 3 = 1"), rows.where("obs_id % 3 = 1"), rows.where("obs_id % 3 = 2"), rows.limit(0)):
        grid.merge_rows(part, grid.HALF_HOUR_GRID, path)
    kept, whole = grid.read_grid(spark, path).drop("date"), grid.representative_grid(rows, grid.HALF_HOUR_GRID)
    assert kept.count() == whole.count() and kept.exceptAll(whole).count() == 0


def test_time_ties_in_a_merged_grid_go_to_the_higher_id(spark):
    rows = bridge.observations(spark, SF).where("altitude > 0 AND temperature > -100 AND distance < 100").limit(1)
    path = fresh_folder(spark, "grid")
    for number, temperature in ((5, 1.0), (9, 2.0), (7, 3.0)):
        tied = rows.withColumns({"obs_id": F.lit(number).cast("long"), "temperature": F.lit(temperature)})
        grid.merge_rows(tied, grid.HALF_HOUR_GRID, path)
    assert [r.temperature for r in grid.read_grid(spark, path).collect()] == [2.0]


def test_a_busy_aircraft_holds_one_state_row_per_slot(spark):
    """Positions and probes of two seconds of one aircraft: no pairs, and the last message wins an instant."""
    rows = spark.range(600).withColumn("time", F.timestamp_millis(F.lit(1_704_067_200_000) + F.floor(F.col("id") / 2) * 5))
    places = rows.select(
        F.col("id").alias("seq"), "time", F.lit(" ab").alias("icao"), F.col("id").cast("double").alias("altitude_m"),
        F.lit(35.0).alias("latitude"), F.lit(139.0).alias("longitude"),
    )
    asked = places.select((F.col("seq") + 10_000).alias("seq"), F.expr("time + INTERVAL 1 MILLISECOND").alias("time"), F.lit("Ab").alias("icao"))
    late = F.expr("time + INTERVAL 1 DAY")
    places = places.unionByName(places.limit(1).withColumns({"time": late, "icao": F.lit("zz")}))
    asked = asked.unionByName(asked.limit(1).withColumns({"time": late, "icao": F.lit("zy")}))

    def stream(path):
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    found = jobs.nearest_position_stream(stream(land(spark, asked)), stream(land(spark, places)), 60)
    out = fresh_folder(spark, "out")
    query = found.writeStream.option("checkpointLocation", fresh_folder(spark, "mark")).trigger(availableNow=True).format("parquet").start(out)
    assert query.awaitTermination(90)
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert 0 < max(held) <= 6
    got = {r.seq: (r.altitude_m, r.gap_s) for r in spark.read.parquet(out).collect()}
    assert got == {10_000 + n: (float(n // 2 * 2 + 1), 0.001) for n in range(600)}


def test_folding_a_busy_aircraft_keeps_few_rows_as_objects():
    n = 60_000
    names = [*fragments._FIELDS]
    rows = pd.DataFrame({name: np.full(n, np.nan) for name in names}).assign(
        callsign=None, seq=np.arange(n)[::-1], at=np.arange(n)[::-1], time=pd.Timestamp("2024-01-01"), icao="A", t44=1.5
    )
    tracemalloc.start()
    out, left, seen = fragments.pair_fragments(rows, dict.fromkeys(names), None, 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out, left["t44"], seen) == ([], 1.5, n - 1)
    assert peak < 50e6


def test_rows_that_land_in_turn_are_made_by_several_tasks(spark):
    def marked(frames):
        for frame in frames:
            yield frame.assign(task=TaskContext.get().partitionId())

    rows = spark.range(0, 3000, 1, 4).select("id", F.timestamp_seconds("id").alias("time"))
    path = catalog._in_turn(spark, rows.mapInPandas(marked, "id long, time timestamp, task int"), "time", "turn")
    got = spark.read.parquet(path)
    assert got.select("id").distinct().count() == got.count() == 3000
    assert got.select(F.input_file_name()).distinct().count() == 3
    assert got.select("task").distinct().count() > 1
