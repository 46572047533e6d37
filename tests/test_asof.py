"""Nearest-position lookups: literal cases, brute force, slices, plans."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skysonde.operators import asof

T0 = datetime(2024, 1, 1)
POSITION = (
    "seq long, icao string, callsign string, time timestamp_ntz, altitude_m double, "
    "latitude double, longitude double"
)


def positions(spark, rows):
    return spark.createDataFrame(
        [(n, icao, name, T0 + timedelta(seconds=s), float(a), 35.0, 139.0)
         for n, icao, name, s, a in rows], POSITION)


def probes(spark, rows):
    return spark.createDataFrame(
        [(n, icao, T0 + timedelta(seconds=s)) for n, icao, s in rows],
        "seq long, icao string, time timestamp_ntz")


def altitudes(df):
    return {r.seq: (r.match.altitude_m if r.match else None) for r in df.collect()}


def test_nearer_position_wins_and_ties_go_to_the_later(spark):
    places = positions(spark, [
        (1, "A", None, -30, 9000), (2, "A", None, 20, 11000),
        (3, "B", None, -20, 1), (4, "B", None, 20, 2), (5, "C", None, 120, 3),
        (6, "D", None, 0, 4), (7, "D", None, 0, 5)])
    found = asof.nearest_by_time(
        probes(spark, [(11, "A", 0), (12, "B", 0), (13, "C", 0), (14, "D", 0), (15, None, 0)]), places)
    assert altitudes(found) == {11: 11000, 12: 2, 13: None, 14: 5, 15: None}
    labels = {r.seq: r.match_source for r in found.collect()}
    assert labels[14] == "adsb" and labels[11] == "interpolated" and labels[13] is None


def test_order_lookup(spark):
    places = positions(spark, [(5000, "A", None, 0, 100), (5010, "A", None, 0, 200)])
    rows = probes(spark, [(5001, "A", 0), (1, "A", 0), (5005, "A", 0), (5012, "A", 0)])
    found = asof.nearest_by_order(rows, places, 10)
    assert altitudes(found) == {5001: 100, 1: None, 5005: 200, 5012: 200}
    back = asof.nearest_by_order(rows, places, 10, backward_only=True)
    assert altitudes(back) == {5001: 100, 1: None, 5005: 100, 5012: 200}


def test_equals_brute_force_across_slices_with_one_hot_aircraft(spark):
    rng = random.Random(1)
    icaos = ["HOT"] * 6 + ["B", "C", "D"]
    place_rows = [(n, rng.choice(icaos), None, rng.randrange(0, 9000), n) for n in range(900)]
    probe_rows = [(n, rng.choice(icaos), rng.randrange(0, 9000)) for n in range(1000, 1900)]
    found = altitudes(asof.nearest_by_time(
        probes(spark, probe_rows), positions(spark, place_rows), window_s=30))
    for n, icao, at in probe_rows:
        near = [(abs(s - at), -s, -m, m) for m, i, _c, s, _a in place_rows
                if i == icao and abs(s - at) <= 30]
        assert found[n] == (min(near)[3] if near else None)


def test_identifier_may_be_address_or_callsign(spark):
    places = positions(spark, [
        (1, "abc", "JAL1", 0, 1), (2, "def", " jal1 ", 5, 1), (3, "ghi", "ANA2", 6, 1)])
    rows = spark.createDataFrame(
        [(1, " abc"), (2, "JAL1"), (3, "nobody"), (4, None)], "n int, identifier string")
    got = {r.n: r.resolved_icao for r in asof.resolve_identifier(rows, places).collect()}
    assert got == {1: "ABC", 2: "DEF", 3: None, 4: None}


def test_xid_serves_one_report(spark):
    reports = spark.createDataFrame(
        [(n, T0 + timedelta(seconds=s), "A", None, -40) for n, s in ((2, 10), (4, 20), (6, 60), (8, 900))],
        "seq long, received_at timestamp_ntz, icao string, altitude_ft int, temperature_c int")
    xid = spark.createDataFrame(
        [(1, T0, "A", 35.0, 139.0, 30000), (5, T0 + timedelta(seconds=50), "A", 35.0, 139.0, 31000)],
        "seq long, received_at timestamp_ntz, icao string, latitude double, longitude double, altitude_ft int")
    got = {r.seq: r.xid.altitude_ft for r in asof.xid_fill(reports, xid).collect()}
    assert got == {2: 30000, 6: 31000}


def test_lookup_builds_no_pairs_and_shuffles_once(spark):
    found = asof.nearest_by_time(
        probes(spark, [(1, "A", 0)]), positions(spark, [(1, "A", None, 0, 1)]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange hashpartitioning(_aircraft") == 1
    assert F is not None


def test_addresses_match_in_any_case(spark):
    places = positions(spark, [
        (1, "abc123", "fl1 ", 0, 9000), (2, " ABC123 ", None, 40, 9100), (3, "DEF456", " FL2", 0, 5000)])
    rows = probes(spark, [(11, "Abc123", 5), (12, "abc123 ", 38), (13, "def456", 0), (14, "", 0)])
    assert altitudes(asof.nearest_by_time(rows, places)) == {11: 9000, 12: 9100, 13: 5000, 14: None}
    assert altitudes(asof.nearest_by_order(rows, places)) == {11: 9100, 12: 9100, 13: 5000, 14: None}
    named = spark.createDataFrame([(1, "Fl1"), (2, "def456"), (3, " fl2 "), (4, None), (5, "x")], "n int, identifier string")
    found = {r.n: r.resolved_icao for r in asof.resolve_identifier(named, places).collect()}
    assert found == {1: "ABC123", 2: "DEF456", 3: "DEF456", 4: None, 5: None}
    reports = spark.createDataFrame(
        [(n, T0 + timedelta(seconds=n), T0, icao, "", "", "fl", None, None, None, -10, None, None)
         for n, icao in ((50, "abc123"), (51, "ABC123"))],
        "seq long, received_at timestamp_ntz, message_time timestamp_ntz, icao string, flight string, reg string, "
        "format string, latitude double, longitude double, altitude_ft int, temperature_c int, wind_dir_deg int, "
        "wind_speed_kt int")
    nothing = spark.createDataFrame([], "seq long, received_at timestamp_ntz, icao string, latitude double, "
                                        "longitude double, altitude_ft int")
    assert asof.fill_altitude(reports, places, nothing).count() == 2
    assert asof.fill_altitude_by_order(reports, places).count() == 2
