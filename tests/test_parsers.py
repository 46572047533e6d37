"""Weather text and datalink documents against literal messages."""

import json

import pytest
from pyspark.sql import functions as F

from skysonde.functions.acars import with_weather_text
from skysonde.sources import messages

CASES = {
    "WN35123E136555014610P24008M33260081027720": (
        "wn", 35 + 12.3 / 60, 136 + 55.5 / 60, 24008, -33, 260, 81),
    "WN34514E13729000390739998-48258119 54770": (
        "wn", 34 + 51.4 / 60, 137 + 29 / 60, 39998, -48, 258, 119),
    "Header\r\nWN35050E13655100384918002-24291044005200\r\nFooter": (
        "wn", 35 + 5.0 / 60, 136 + 55.1 / 60, 18002, -24, 291, 44),
    "WN35109E13775005756140002-49257115 10800": None,
    "N34571E137256020924001-34258 69 106": ("pntaf", 34.571, 137.256, None, -34, 258, 69),
    "N35053E137022023522410M302590750086": ("pntaf", 35.053, 137.022, 41000, -30, 259, 75),
    "N35053E137022023522410M302590750086 N34571E137256020924001-34258 69 106": (
        "pntaf", 34.571, 137.256, None, -34, 258, 69),
    "FL350 M45": ("fl", None, None, 35000, -45, None, None),
    "FL350/-45": ("fl", None, None, 35000, -45, None, None),
    "FL350": ("fl", None, None, 35000, None, None, None),
    "no weather here": None,
}


def test_weather_text(spark):
    texts = list(CASES)
    rows = with_weather_text(
        spark.createDataFrame(list(enumerate(texts)), "n int, msg_text string")
    ).select("n", "format", "weather.*")
    got = {texts[r.n]: r for r in rows.collect()}
    for text, expected in CASES.items():
        r = got[text]
        if expected is None:
            assert r.format is None, text
            continue
        fmt, lat, lon, *rest = expected
        assert (r.format, [r.altitude_ft, r.temperature_c, r.wind_dir_deg, r.wind_speed_kt]) == (
            fmt, rest), text
        for value, wanted in ((r.latitude, lat), (r.longitude, lon)):
            assert value == (None if wanted is None else pytest.approx(wanted)), text


def document(**avlc):
    return json.dumps({"vdl2": {"t": {"sec": 1704067200, "usec": 5}, "avlc": avlc}})


def test_datalink_documents(spark):
    location = {"name": "ac_location", "value": {"loc": {"lat": 35.5, "lon": 139.5}, "alt": 12000}}
    lines = [
        "{broken",
        "[1, 2]",
        document(src={"addr": "84C27A"}, xid={"vdl_params": [{"name": "x", "value": [1]}, location]}),
        document(src={"addr": ""}, xid={"vdl_params": [location]}),
        document(src={"addr": "84C27B"}, xid={"vdl_params": []}),
        document(src={"addr": "84C27C"}, acars={"flight": "JL1", "reg": "JA1", "msg_text": "FL350 M45"}),
        document(src={"addr": "84C27D"}, acars={"flight": "JL2", "msg_text": ""}),
    ]
    df = spark.createDataFrame(
        [(i, None, line) for i, line in enumerate(lines)], "seq long, received_at timestamp, line string"
    )
    docs = messages.parse_datalink(df)
    assert {r.seq for r in docs.collect()} == {2, 3, 4, 5, 6}
    xid = messages.xid_reports(docs).collect()
    assert [(r.seq, r.icao, r.altitude_ft, r.latitude) for r in xid] == [(2, "84C27A", 12000, 35.5)]
    reports = messages.acars_reports(docs).collect()
    assert [(r.seq, r.flight, r.altitude_ft, r.temperature_c) for r in reports] == [(5, "JL1", 35000, -45)]
    assert docs.select(messages.datalink_time().alias("t")).first().t.microsecond == 5


def test_json_and_text_are_parsed_once(spark):
    """Filters must not pull the parsing expressions below the stage that makes them."""
    df = spark.createDataFrame([], "seq long, received_at timestamp, line string")
    reports = messages.acars_reports(messages.parse_datalink(df)).where(
        F.col("altitude_ft").isNotNull() & F.col("temperature_c").isNotNull()
    )
    plan = reports._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_hex_lines(spark):
    lines = ["*8D84C27A58C382D690C8AC2863A7;", "*02E1971CE17C84;", "8D84C27A58C382D690C8AC2863A7;", ""]
    df = spark.createDataFrame([(v,) for v in lines], "line string")
    assert [r.hex for r in messages.modes_hex_lines(df).collect()] == ["8D84C27A58C382D690C8AC2863A7"]
