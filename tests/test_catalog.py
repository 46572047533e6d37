"""Registered queries against their SQL counterparts on the smallest tables.

All of them with SKYSONDE_ALL=1; otherwise one or two of every kind.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = (
    "s1_modes_line_scan", "p12_period_clamp", "f12_acars_format_priority", "j5_altitude_cascade",
    "j6_register_pairs", "j10_altitude_neighbours", "a5_receiver_quality", "a7_half_hour_grid",
    "a11_temperature_profile", "a14_anchored_bins", "a17_outlier_flags", "g2_temperature_surface",
    "t3_latest_rows", "w4_gap_islands", "v8_wind_direction",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("SKYSONDE_ALL") else SOME


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    result = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.collect(), df.columns) == normal(result.fetchall(), columns)
