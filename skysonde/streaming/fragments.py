"""Keyed fragment state: register pairing and XID buffering on live streams.

State is one small row per aircraft.  Within a micro-batch the rows of an
aircraft are put in message order first, as columns of plain numbers, and folded
a few thousand at a time; batches are bounded at the source.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skysonde import settings as S
from skysonde.functions.geo import haversine_km
from skysonde.functions.physics import air_temperature_c, wind_from_knots, wind_triangle
from skysonde.functions.units import feet_to_metres, knots_to_ms
from skysonde.operators.asof import report_observations
from skysonde.sources.messages import usable_fields

_STATE = (
    "seen long, callsign string, altitude_ft double, lat double, lon double, "
    "t44 double, s44 double, d44 double, "
    "trk double, gs double, tas double, hdg double, mach double"
)
_FIELDS = [part.strip().split()[0] for part in _STATE.split(",")][1:]
_COMPLETE = (
    "seq long, time timestamp, icao string, data_source string, callsign string, "
    "altitude_ft double, lat double, lon double, t44 double, s44 double, d44 double, "
    "trk double, gs double, tas double, hdg double, mach double"
)
_COMPLETE_NAMES = [part.strip().split()[0] for part in _COMPLETE.split(",")]


#: Rows of an aircraft that are turned into Python objects at a time.
FOLDED_ROWS = 10_000


def _known(fragment: dict, *names: str) -> bool:
    return all(fragment[n] is not None for n in names)


def _ready(fragment: dict) -> str | None:
    """Which kind of report the fragment can give, direct reports first."""
    if not _known(fragment, "callsign", "altitude_ft", "lat", "lon"):
        return None
    if _known(fragment, "t44", "s44", "d44"):
        return "bds44"
    return "bds50_60" if _known(fragment, "trk", "gs", "tas", "hdg", "mach") else None


def _value(value: object) -> object:
    return None if pd.isna(value) else value


def _columns(frames: Iterable[pd.DataFrame], names: Iterable[str]) -> dict[str, np.ndarray]:
    """Columns of all frames; equal texts are one object, and no frame is kept."""
    texts: dict[str, str] = {}
    parts: dict[str, list[np.ndarray]] = {n: [] for n in names}
    for frame in frames:
        for name, found in parts.items():
            values = frame[name].to_numpy()
            if values.dtype == object:
                values = np.array([texts.setdefault(v, v) if isinstance(v, str) else v for v in values], dtype=object)
            found.append(values)
    return {n: np.concatenate(parts.pop(n)) for n in list(parts)}


def _plain_columns(columns: dict[str, np.ndarray], names: list[str], order: np.ndarray) -> list[list]:
    """Some rows of the columns as lists, with None for what is missing."""
    out = []
    for name in names:
        values = pd.Series(columns[name][order])
        out.append(values.astype(object).where(values.notna(), None).tolist())
    return out


def _folded(
    frames: Iterable[pd.DataFrame], icao: str | None, fragment: dict, seen: int | None, ttl_s: int
) -> Iterator[tuple[list[dict], dict, int | None]]:
    """Complete fragments of so many rows of one aircraft at a time, with the fragment they leave."""
    columns = _columns(frames, ["seq", "time", "at", *_FIELDS])
    order = np.argsort(columns["seq"], kind="stable")
    held = [fragment[n] for n in _FIELDS]
    for first in range(0, len(order), FOLDED_ROWS):
        part = order[first : first + FOLDED_ROWS]
        out = []
        lists = _plain_columns(columns, ["at", "seq", *_FIELDS], part)
        for i, (at, seq, *fields) in enumerate(zip(*lists)):
            at = int(at)
            if seen is not None and at - seen > ttl_s * 1_000_000:
                held = [None] * len(_FIELDS)
            seen = at
            held = [old if new is None else new for old, new in zip(held, fields)]
            fragment = dict(zip(_FIELDS, held))
            kind = _ready(fragment)
            if kind is not None:
                time = columns["time"][part[i]]
                out.append({**fragment, "seq": seq, "time": time, "icao": icao, "data_source": kind})
                held = [None] * len(_FIELDS)
        yield out, dict(zip(_FIELDS, held)), seen


def pair_fragments(
    rows: pd.DataFrame, fragment: dict, seen: int | None, ttl_s: int = S.FRAGMENT_TTL_S
) -> tuple[list[dict], dict, int | None]:
    """Fold the rows of one aircraft, in message order, into its fragment.

    A fragment not touched for `ttl_s` is forgotten; a complete one is emitted
    and forgotten whole.
    """
    out = []
    icao = rows["icao"].iloc[0] if len(rows) else None
    for found, fragment, seen in _folded([rows], icao, fragment, seen, ttl_s):
        out += found
    return out, fragment, seen


def _forget_after(state: GroupState, seen: int, seconds: int) -> None:
    """Time out once the watermark is `seconds` past the last row, in microseconds."""
    expiry = seen // 1000 + seconds * 1000
    state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))


def fragment_updates(messages: DataFrame) -> DataFrame:
    """Messages that change a fragment, with their fields side by side."""
    usable = usable_fields(messages)
    position = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    changed = (
        F.col("callsign").isNotNull()
        | position
        | F.col("bds44").isNotNull()
        | F.col("bds50").isNotNull()
        | F.col("bds60").isNotNull()
    )
    return usable.where(changed).select(
        "seq",
        F.col("time").cast("timestamp").alias("time"),
        F.unix_micros(F.col("time").cast("timestamp")).alias("at"),
        "icao",
        "callsign",
        F.when(position, F.col("altitude_ft")).alias("altitude_ft"),
        "lat",
        "lon",
        F.col("bds44.temperature").alias("t44"),
        F.col("bds44.wind_speed_kt").alias("s44"),
        F.col("bds44.wind_direction").alias("d44"),
        F.col("bds50.trackangle").alias("trk"),
        F.col("bds50.groundspeed_kt").alias("gs"),
        F.col("bds50.trueair_kt").alias("tas"),
        F.col("bds60.heading").alias("hdg"),
        F.col("bds60.mach").alias("mach"),
    )


def live_pairs(
    messages: DataFrame, ttl_s: int = S.FRAGMENT_TTL_S, lateness: str = "1 minute"
) -> DataFrame:
    """Complete fragments of a message stream.

    State of an aircraft is dropped when the watermark passes its time to live,
    so it is bounded by the aircraft heard lately.
    """

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (None,) * (len(_FIELDS) + 1)
        fragment, seen = dict(zip(_FIELDS, held[1:])), held[0]
        for found, fragment, seen in _folded(batches, key[0], fragment, seen, ttl_s):
            if found:
                yield pd.DataFrame(found)[_COMPLETE_NAMES]
        state.update((seen, *[fragment[n] for n in _FIELDS]))
        _forget_after(state, seen, ttl_s)

    return (
        fragment_updates(messages)
        .withWatermark("time", lateness)
        .groupBy("icao")
        .applyInPandasWithState(
            step, _COMPLETE, _STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def pair_observations(pairs: DataFrame) -> DataFrame:
    """Complete fragments as observations; impossible temperatures are dropped."""
    direct = F.col("data_source") == "bds44"
    air = knots_to_ms(F.col("tas"))
    place = (F.col("lat"), F.col("lon"))
    wind = F.when(direct, wind_from_knots(F.col("s44"), F.col("d44"))).otherwise(
        wind_triangle(*place, F.col("trk"), knots_to_ms(F.col("gs")), F.col("hdg"), air)
    )
    temperature = F.when(direct, F.col("t44")).otherwise(air_temperature_c(air, F.col("mach")))
    return (
        pairs.withColumns({"_wind": wind, "temperature": temperature})
        .where(F.col("temperature") >= S.TEMPERATURE_FLOOR_C)
        .select(
            F.col("seq").alias("obs_id"),
            "time",
            "callsign",
            "icao",
            haversine_km(*place).alias("distance"),
            feet_to_metres(F.col("altitude_ft")).alias("altitude"),
            F.col("lat").alias("latitude"),
            F.col("lon").alias("longitude"),
            "temperature",
            F.col("_wind.x").alias("wind_x"),
            F.col("_wind.y").alias("wind_y"),
            F.col("_wind.angle").alias("wind_angle"),
            F.col("_wind.speed").alias("wind_speed"),
            F.lit(S.MODE_S).alias("method"),
            "data_source",
            F.lit("adsb").alias("altitude_source"),
        )
    )


_XID_STATE = "at long, altitude_ft int, latitude double, longitude double"
_JOINED = (
    "seq long, received_at timestamp, icao string, flight string, reg string, "
    "latitude double, longitude double, altitude_ft int, temperature_c int, "
    "wind_dir_deg int, wind_speed_kt int"
)
_JOINED_NAMES = [part.strip().split()[0] for part in _JOINED.split(",")]


def join_fragments(
    rows: pd.DataFrame, xid: tuple | None, timeout_s: int, evict_s: int
) -> tuple[list[dict], tuple | None]:
    """Fold ordered XID and weather rows of one aircraft.

    The newest XID is held; a weather row without altitude within `timeout_s`
    takes it.  A held XID is dropped `evict_s` after it came.
    """
    out = []
    ordered = rows.sort_values(["at", "seq"])
    parts = (ordered.iloc[n : n + FOLDED_ROWS] for n in range(0, len(ordered), FOLDED_ROWS))
    for row in (row for part in parts for row in part.to_dict("records")):
        at = int(row["at"])
        if xid is not None and at - xid[0] > evict_s * 1_000_000:
            xid = None
        if row["is_xid"]:
            place = (_value(row["latitude"]), _value(row["longitude"]))
            xid = (at, int(row["altitude_ft"]), *place)
        elif xid is not None and at - xid[0] <= timeout_s * 1_000_000:
            filled = {n: _value(row[n]) for n in _JOINED_NAMES}
            filled["altitude_ft"] = xid[1]
            filled["latitude"] = xid[2] if xid[2] is not None else filled["latitude"]
            filled["longitude"] = xid[3] if xid[3] is not None else filled["longitude"]
            out.append(filled)
            xid = None
    return out, xid


def fragment_stream(
    reports: DataFrame,
    xid: DataFrame,
    timeout_s: int = S.FRAGMENT_TTL_S,
    evict_s: int = S.FRAGMENT_EVICT_S,
    lateness: str = "1 minute",
) -> DataFrame:
    """Weather rows without altitude, completed by the aircraft's newest XID."""
    common = ["seq", "received_at", "icao", "latitude", "longitude", "altitude_ft"]
    asking = reports.where(
        F.col("icao").isNotNull()
        & F.col("altitude_ft").isNull()
        & F.col("temperature_c").isNotNull()
    ).select(
        *common, "flight", "reg", "temperature_c", "wind_dir_deg", "wind_speed_kt",
        F.lit(False).alias("is_xid"),
    )
    rows = asking.unionByName(
        xid.select(*common, F.lit(True).alias("is_xid")), allowMissingColumns=True
    )
    rows = rows.withColumns(
        {
            "received_at": F.col("received_at").cast("timestamp"),
            "at": F.unix_micros(F.col("received_at").cast("timestamp")),
        }
    ).withWatermark("received_at", lateness)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        found, left = join_fragments(pd.concat(list(batches)), held, timeout_s, evict_s)
        if left is None:
            state.remove()
        else:
            state.update(left)
            _forget_after(state, left[0], evict_s)
        if found:
            yield pd.DataFrame(found)[_JOINED_NAMES].astype(
                {n: "Int32" for n in ("altitude_ft", "temperature_c", "wind_dir_deg", "wind_speed_kt")}
            )

    return rows.groupBy("icao").applyInPandasWithState(
        step, _JOINED, _XID_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def fragment_observations(joined: DataFrame) -> DataFrame:
    return report_observations(joined.withColumn("altitude_source", F.lit("xid")))
