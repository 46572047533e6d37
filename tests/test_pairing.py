"""Register pairing against a plain state machine."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysonde import bridge, schemas
from skysonde.operators import pairing
from skysonde.streaming import fragments

T0 = datetime(2024, 1, 1)


def random_messages(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        icao = rng.choice(["HOT"] * 5 + ["B", "C"])
        row = dict(seq=seq, time=T0 + timedelta(seconds=seq * 7), icao=icao, df=20, typecode=None,
                   callsign=None, altitude_ft=None, lat=None, lon=None, bds=None, bds44=None,
                   bds50=None, bds60=None)
        kind = rng.choice(["50", "50", "60", "60", "17", "44", "pos", "name"])
        if seq < 12 and kind == "pos":
            kind = "50"
        if kind == "pos":
            row.update(df=17, typecode=11, altitude_ft=float(rng.choice([0, 20000 + seq])))
            if rng.random() < 0.7:
                row.update(lat=35.0 + seq / 1e4, lon=139.0)
        elif kind == "name":
            row.update(df=17, typecode=4, callsign=f"N{seq}__")
        elif kind == "50":
            row.update(bds="50", bds50=(float(seq % 360), 400.0, None if rng.random() < 0.1 else 420.0))
        elif kind == "60":
            row.update(bds="60", bds60=(float(seq % 360), 280.0, rng.choice([0.0, 0.78, 0.8])))
        elif kind == "44":
            row.update(bds="44", bds44=(-40.0, 50.0, 270.0))
        else:
            row.update(bds="17")
        rows.append(row)
    frame = spark.createDataFrame([tuple(r[f.name] for f in schemas.MODES_MESSAGES) for r in rows],
                                  schemas.MODES_MESSAGES)
    return rows, frame


def replay_by_hand(rows):
    """Sequence numbers of pair completions and of both registers used."""
    held, out = {}, []
    for r in rows:
        h = held.setdefault(r["icao"], {"b50": None, "b60": None, "pos": False})
        if r["typecode"] == 11 and r["altitude_ft"] and r["lat"] is not None:
            h["pos"] = True
        if r["df"] != 20 or r["bds"] == "44":
            continue
        if r["bds"] == "50" and None not in r["bds50"]:
            h["b50"] = r["bds50"]
        if r["bds"] == "60" and None not in r["bds60"]:
            h["b60"] = r["bds60"]
        if h["b50"] and h["b60"] and h["pos"]:
            out.append((r["seq"], h["b50"][0], h["b60"][0]))
            h["b50"] = h["b60"] = None
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 42])
def test_pairs_equal_the_state_machine_over_many_slices(spark, seed):
    rows, frame = random_messages(spark, 500, seed)
    for width in (17, 1_000_000):
        got = pairing.paired_rows(frame, width).select(
            "seq", "last_bds50.trackangle", "last_bds60.heading").collect()
        assert sorted(tuple(r) for r in got) == replay_by_hand(rows)


def test_carried_values_equal_a_plain_window(spark):
    messages = bridge.modes_messages(spark, "/root/testdata/sf0.001")
    columns = ("seq", "last_callsign", "last_altitude_ft", "last_lat")
    small = pairing.aircraft_state(messages, 50).select(*columns).toPandas().sort_values("seq")
    whole = pairing.aircraft_state(messages).select(*columns).toPandas().sort_values("seq")
    pd.testing.assert_frame_equal(small.reset_index(drop=True), whole.reset_index(drop=True))


def test_live_fragment_rules():
    blank = dict.fromkeys(fragments._FIELDS)

    def row(seq, **fields):
        return {**blank, "seq": seq, "at": seq * 1_000_000, "time": None, "icao": "A", **fields}

    place = dict(altitude_ft=30000.0, lat=35.0, lon=139.0)
    b50 = dict(trk=1.0, gs=400.0, tas=420.0)
    b60 = dict(hdg=2.0, mach=0.8)
    b44 = dict(t44=-40.0, s44=10.0, d44=20.0)
    rows = pd.DataFrame([
        row(1, **b50), row(2, **b60), row(3, **place), row(4, callsign="X"),  # complete here
        row(5, **b50), row(6, **b60),  # all was dropped: still no callsign or place
        row(7, callsign="X"), row(8, **b44), row(9, **place),  # direct report goes first
        row(400, callsign="X"),  # forgotten after five minutes
        row(401, **b44)])
    out, left, seen = fragments.pair_fragments(rows, dict(blank), None)
    assert [(r["seq"], r["data_source"]) for r in out] == [(4, "bds50_60"), (9, "bds44")]
    assert left["callsign"] == "X" and left["lat"] is None and seen == 401_000_000


def test_xid_fragment_rules():
    def row(seq, xid, **fields):
        base = dict.fromkeys(fragments._JOINED_NAMES)
        return {**base, "seq": seq, "at": seq * 1_000_000, "is_xid": xid, **fields}

    rows = pd.DataFrame([
        row(1, True, altitude_ft=30000, latitude=35.0, longitude=139.0),
        row(2, False, temperature_c=-40), row(3, False, temperature_c=-41),
        row(10, True, altitude_ft=31000), row(11, True, altitude_ft=32000),
        row(400, False, temperature_c=-42), row(700, False, temperature_c=-43)])
    out, left = fragments.join_fragments(rows, None, 300, 600)
    assert [(r["seq"], r["altitude_ft"]) for r in out] == [(2, 30000)]
    assert left is None


def test_impossible_temperatures_are_dropped(spark):
    _rows, frame = random_messages(spark, 300, 3)
    found = pairing.paired_observations(frame)
    assert found.count() > 0
    assert found.where(F.col("temperature").isNull() | (F.col("temperature") < -100)).count() == 0
