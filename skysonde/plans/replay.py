"""Replay of recorded messages into one list of clean observations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.functions.acars import with_weather_text
from skysonde.functions.units import feet_to_metres
from skysonde.operators.asof import fill_altitude_by_order, report_observations
from skysonde.operators.filters import drop_absurd_temperature, is_valid_observation
from skysonde.operators.outliers import usable_history, without_outliers
from skysonde.operators.pairing import aircraft_state, replay_observations
from skysonde.operators.running import SLICE_WIDTH
from skysonde.sources.storage import materialized
from skysonde.sources.messages import acars_reports, parse_datalink, xid_reports


def replay_positions(messages: DataFrame, docs: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Position history of a replay: Mode S positions and callsigns, and XID reports.

    A callsign row repeats the position the aircraft was last seen at; an XID
    counts only in a message without weather text.
    """
    state = aircraft_state(messages, width)
    fed = F.col("altitude_ft").isNotNull() | (
        F.col("callsign").isNotNull() & F.col("last_altitude_ft").isNotNull()
    )
    modes = state.where(fed).select(
        "seq",
        "icao",
        F.col("last_callsign").alias("callsign"),
        "time",
        feet_to_metres(F.col("last_altitude_ft")).alias("altitude_m"),
        F.col("last_lat").alias("latitude"),
        F.col("last_lon").alias("longitude"),
    )
    silent = with_weather_text(
        docs.withColumn("msg_text", F.col("doc.vdl2.avlc.acars.msg_text"))
    ).where(F.col("weather").isNull())
    xid = (
        xid_reports(silent)
        .where(F.col("altitude_ft") != 0)
        .select(
            "seq",
            "icao",
            F.lit(None).cast("string").alias("callsign"),
            F.col("received_at").alias("time"),
            feet_to_metres(F.col("altitude_ft").cast("double")).alias("altitude_m"),
            "latitude",
            "longitude",
        )
    )
    return modes.unionByName(xid)


def replay(
    messages: DataFrame,
    lines: DataFrame,
    outliers: bool = True,
    rounds: int = 1,
    width: int = SLICE_WIDTH,
) -> DataFrame:
    """Observations of both methods.  `seq` must run on from the messages to the lines.

    Mode S rows of a replay carry no trusted time and sort last.  The position
    history and the merged rows are read several times each and are therefore
    written to the shared folder once.
    """
    docs = parse_datalink(lines)
    positions = materialized(replay_positions(messages, docs, width), "positions")
    reports = fill_altitude_by_order(acars_reports(docs), positions)
    merged = merge_observations(
        replay_observations(messages, width).withColumn("time", F.lit(None).cast("timestamp_ntz")),
        report_observations(reports, live=False),
    ).where(is_valid_observation())
    if not outliers:
        return merged
    clean = materialized(drop_absurd_temperature(merged), "replay")
    return without_outliers(clean, usable_history(clean), rounds)


def merge_observations(modes: DataFrame, vdl2: DataFrame) -> DataFrame:
    """Observations of both methods in one relation; nothing is deduplicated."""
    return modes.unionByName(vdl2)


def in_time_order(observations: DataFrame) -> DataFrame:
    """By time, rows without a time last."""
    return observations.orderBy(F.asc_nulls_last("time"), F.asc("obs_id"))
