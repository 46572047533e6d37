"""Nearest-in-time and nearest-in-order position lookups, and the altitude fill.

All lookups have a fixed reach, so time (or order) is cut into slices and the
lookup rows near an edge are copied to the neighbouring slice.  Each (aircraft,
slice) is then complete on its own: a busy aircraft spreads over many tasks and
no pairs are ever built.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.geo import flat_distance_km, haversine_km
from skysonde.functions.identifiers import normal_identifier
from skysonde.functions.physics import wind_from_knots
from skysonde.functions.timebins import micros
from skysonde.functions.units import feet_to_metres, metres_to_whole_feet

# A slice is this many times as wide as the reach, which keeps the copied share small.
SLICE_FACTOR = 10


def _nearest(
    probes: DataFrame,
    lookup: DataFrame,
    key: str,
    at: str,
    reach: int,
    payload: str,
    backward_only: bool = False,
    result: str = "match",
) -> DataFrame:
    """Probes with the `payload` of the nearest lookup row and its distance.

    `at` is a whole number on both sides; `lookup` also has `seq` to order rows
    at the same place.  Ties between both sides go to the later row.
    """
    width = reach * SLICE_FACTOR
    # A lookup row serves the slices of all probes within its reach.
    reached = F.floor((F.col(at) + F.lit(reach)) / F.lit(width))
    earliest = F.col(at) if backward_only else F.col(at) - F.lit(reach)
    first = F.floor(earliest / F.lit(width))
    right = lookup.select(
        key,
        at,
        F.col("seq").alias("_seq"),
        F.col(payload),
        F.explode(F.sequence(first, reached)).alias("_slice"),
        F.lit(False).alias("_probe"),
    )
    left = probes.withColumns(
        {"_slice": F.floor(F.col(at) / F.lit(width)), "_probe": F.lit(True)}
    )
    both = left.unionByName(right, allowMissingColumns=True)
    candidate = F.when(
        ~F.col("_probe"), F.struct(F.col(at).alias("at"), F.col(payload).alias("row"))
    )
    # Rows at the probe's own place belong to the backward side: they sort first.
    ordered = Window.partitionBy(key, "_slice").orderBy(
        F.col(at), F.col("_probe"), F.col("_seq").asc_nulls_last()
    )
    before = F.last(candidate, ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    columns = {"_before": before}
    if not backward_only:
        # Forward side: the last of the rows at the next place, hence the reverse order.
        reverse = Window.partitionBy(key, "_slice").orderBy(
            F.col(at).desc(), F.col("_probe").desc(), F.col("_seq").asc_nulls_first()
        )
        columns["_after"] = F.last(candidate, ignorenulls=True).over(
            reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
    matched = both.withColumns(columns).where(F.col("_probe"))
    gap_before = F.col(at) - F.col("_before.at")
    near_before = gap_before <= reach
    if backward_only:
        chosen = F.when(near_before, F.col("_before"))
    else:
        gap_after = F.col("_after.at") - F.col(at)
        near_after = gap_after <= reach
        chosen = F.when(
            near_after & (F.coalesce(gap_after <= gap_before, F.lit(True)) | ~near_before),
            F.col("_after"),
        ).when(near_before, F.col("_before"))
    return (
        matched.withColumn("_chosen", chosen)
        .withColumns(
            {
                result: F.col("_chosen.row"),
                f"{result}_offset": F.col("_chosen.at") - F.col(at),
            }
        )
        .drop("_slice", "_probe", "_seq", "_before", "_after", "_chosen", payload)
    )


def _position_payload(positions: DataFrame) -> DataFrame:
    """Positions keyed by the normal form of their address."""
    return positions.select(
        normal_identifier(F.col("icao")).alias("_aircraft"),
        "time",
        "seq",
        F.struct("altitude_m", "latitude", "longitude", "seq").alias("_position"),
    ).where(F.col("_aircraft").isNotNull())


def altitude_source_label(offset_s: Column) -> Column:
    return F.when(F.abs(offset_s) < S.EXACT_MATCH_S, "adsb").otherwise("interpolated")


def nearest_by_time(
    probes: DataFrame,
    positions: DataFrame,
    probe_time: str = "time",
    window_s: int = S.POSITION_WINDOW_S,
) -> DataFrame:
    """Position of the same aircraft nearest in time, at most `window_s` away.

    Of two equally near positions the later one is taken, and of several at the
    same instant one with the highest `seq`.  Adds `match` (altitude_m, latitude,
    longitude, seq), `offset_s` and `match_source`; unmatched probes keep NULLs.
    """
    right = _position_payload(positions).withColumn("_at", micros(F.col("time")))
    left = probes.withColumns(
        {"_at": micros(F.col(probe_time)), "_aircraft": normal_identifier(F.col("icao"))}
    )
    found = _nearest(left, right, "_aircraft", "_at", window_s * 1_000_000, "_position")
    return (
        found.withColumn("offset_s", F.col("match_offset") / F.lit(1e6))
        .withColumn(
            "match_source",
            F.when(F.col("match").isNotNull(), altitude_source_label(F.col("offset_s"))),
        )
        .drop("_at", "_aircraft", "match_offset")
    )


def nearest_by_order(
    probes: DataFrame,
    positions: DataFrame,
    max_distance: int = S.ORDER_WINDOW,
    backward_only: bool = False,
) -> DataFrame:
    """Position nearest in message order, at most `max_distance` messages away.

    `backward_only` is the replay form, where all positions came earlier.
    """
    right = _position_payload(positions).withColumn("_at", F.col("seq"))
    left = probes.withColumns(
        {"_at": F.col("seq"), "_aircraft": normal_identifier(F.col("icao"))}
    )
    found = _nearest(left, right, "_aircraft", "_at", max_distance, "_position", backward_only)
    return (
        found.withColumn(
            "match_source", F.when(F.col("match").isNotNull(), F.lit("interpolated"))
        )
        .withColumn("index_distance", F.abs("match_offset"))
        .drop("_at", "_aircraft", "match_offset")
    )


def callsign_map(positions: DataFrame) -> DataFrame:
    """Latest aircraft of each callsign, both in normal form."""
    name, aircraft = (normal_identifier(F.col(c)) for c in ("callsign", "icao"))
    return (
        positions.where(name.isNotNull() & aircraft.isNotNull())
        .groupBy(name.alias("callsign"))
        .agg(F.max_by(aircraft, F.col("seq")).alias("icao"))
    )


def resolve_identifier(
    rows: DataFrame, positions: DataFrame, identifier: str = "identifier"
) -> DataFrame:
    """Aircraft address for an identifier that may be an address or a callsign.

    Addresses with a position history win; otherwise the latest mapping of the
    callsign is used.  Both come from one pass over the positions, which leaves a
    row per address and a row per callsign.
    """
    name, aircraft = (normal_identifier(F.col(c)) for c in ("callsign", "icao"))
    said = positions.select("seq", aircraft.alias("_icao"), name.alias("_name")).where("_icao IS NOT NULL")
    each = said.select(
        "seq",
        "_icao",
        F.inline(
            F.array(
                F.struct(F.col("_icao").alias("_said"), F.lit(True).alias("_address")),
                F.struct(F.col("_name").alias("_said"), F.lit(False).alias("_address")),
            )
        ),
    ).where("_said IS NOT NULL")
    latest = F.max_by("_icao", F.when(~F.col("_address"), F.col("seq")))
    names = each.groupBy("_said").agg(
        F.when(F.bool_or("_address"), F.col("_said")).otherwise(latest).alias("resolved_icao")
    )
    return (
        rows.withColumn("_wanted", normal_identifier(F.col(identifier)))
        .join(names, F.col("_wanted") == F.col("_said"), "left")
        .drop("_wanted", "_said")
    )


def xid_match(
    reports: DataFrame,
    xid: DataFrame,
    asking: Column,
    timeout_s: int = S.FRAGMENT_TTL_S,
) -> DataFrame:
    """All reports, the asking ones with the latest earlier XID of their aircraft.

    At most `timeout_s` apart; an XID serves one report only, the first that asks.
    Adds `xid` (altitude_ft, latitude, longitude, seq), NULL where none is left.
    """
    left = reports.withColumns(
        {
            "_at": micros(F.col("received_at")),
            "_asks": asking,
            "_aircraft": normal_identifier(F.col("icao")),
        }
    )
    right = xid.select(
        normal_identifier(F.col("icao")).alias("_aircraft"),
        "seq",
        micros(F.col("received_at")).alias("_at"),
        F.struct("altitude_ft", "latitude", "longitude", "seq").alias("_xid"),
    )
    found = _nearest(
        left, right, "_aircraft", "_at", timeout_s * 1_000_000, "_xid", True, result="xid"
    )
    # Takers of one XID arrive within `timeout_s`; all other rows are alone in their group.
    takes = F.coalesce(F.col("_asks") & F.col("xid").isNotNull(), F.lit(False))
    turn = Window.partitionBy(
        "_aircraft", F.col("xid.seq"), F.when(~takes, F.col("seq"))
    ).orderBy("_at", "seq")
    return (
        found.withColumn("_turn", F.row_number().over(turn))
        .withColumn("xid", F.when(takes & (F.col("_turn") == 1), F.col("xid")))
        .drop("_turn", "_at", "_asks", "_aircraft", "xid_offset")
    )


def lacks_altitude() -> Column:
    """A report that can use an altitude from elsewhere."""
    return (
        F.col("icao").isNotNull()
        & F.col("altitude_ft").isNull()
        & F.col("temperature_c").isNotNull()
    )


def xid_fill(
    reports: DataFrame, xid: DataFrame, timeout_s: int = S.FRAGMENT_TTL_S
) -> DataFrame:
    """Reports completed by an XID alone, with the `xid` they consumed."""
    asking = reports.where(lacks_altitude())
    return xid_match(asking, xid, F.lit(True), timeout_s).where(F.col("xid").isNotNull())


def fill_altitude(
    reports: DataFrame,
    positions: DataFrame,
    xid: DataFrame,
    window_s: int = S.POSITION_WINDOW_S,
    xid_timeout_s: int = S.FRAGMENT_TTL_S,
) -> DataFrame:
    """Altitude cascade: the report's own, the position history, an XID; else dropped.

    The probe time is the time inside the message, falling back to the time of
    arrival.  Coordinates are filled one by one from the history; an XID position
    goes before the report's, and `xid_seq` tells which XID was used up.  All reports go through in one pass: those that
    yield weather are few, reading the lines twice would cost more.
    """
    named = _with_aircraft(reports.where(F.col("temperature_c").isNotNull()), positions)
    probed = nearest_by_time(
        named.withColumn("_probe_time", F.coalesce("message_time", "received_at")),
        positions,
        "_probe_time",
        window_s,
    )
    own_again = probed.drop("icao").withColumnRenamed("_own_icao", "icao")
    asked = xid_match(
        own_again, xid, lacks_altitude() & F.col("match").isNull(), xid_timeout_s
    )
    own = F.col("altitude_ft").isNotNull()
    history = ~own & F.col("match").isNotNull()
    last = ~own & F.col("xid").isNotNull()
    return (
        asked.where(own | history | last)
        .withColumns(
            {
                "altitude_source": F.when(own, "acars")
                .when(history, F.col("match_source"))
                .otherwise("xid"),
                "latitude": F.when(last, F.coalesce("xid.latitude", "latitude"))
                .when(history, F.coalesce("latitude", "match.latitude"))
                .otherwise(F.col("latitude")),
                "longitude": F.when(last, F.coalesce("xid.longitude", "longitude"))
                .when(history, F.coalesce("longitude", "match.longitude"))
                .otherwise(F.col("longitude")),
                "altitude_ft": F.coalesce(
                    "altitude_ft",
                    metres_to_whole_feet(F.col("match.altitude_m")),
                    "xid.altitude_ft",
                ),
                "xid_seq": F.when(last, F.col("xid.seq")),
            }
        )
        .select(*reports.columns, "altitude_source", "xid_seq")
    )


def _with_aircraft(reports: DataFrame, positions: DataFrame) -> DataFrame:
    """Reports with `icao` resolved for the lookup; the stated one in `_own_icao`."""
    named = reports.withColumn(
        "_identifier", F.coalesce(F.col("icao"), F.nullif(F.col("flight"), F.lit("")))
    )
    return (
        resolve_identifier(named, positions, "_identifier")
        .withColumnRenamed("icao", "_own_icao")
        .withColumnRenamed("resolved_icao", "icao")
        .drop("_identifier")
    )


def fill_altitude_by_order(
    reports: DataFrame, positions: DataFrame, max_distance: int = S.ORDER_WINDOW
) -> DataFrame:
    """Replay form of the cascade: own positive altitude, else the order lookup."""
    named = _with_aircraft(reports.where(F.col("temperature_c").isNotNull()), positions)
    found = nearest_by_order(named, positions, max_distance, backward_only=True)
    own = F.coalesce(F.col("altitude_ft") > 0, F.lit(False))
    history = ~own & F.col("match").isNotNull()
    return (
        found.drop("icao")
        .withColumnRenamed("_own_icao", "icao")
        .where(own | history)
        .withColumns(
            {
                "altitude_source": F.when(own, "acars").otherwise(F.col("match_source")),
                "latitude": F.when(
                    history, F.coalesce("latitude", "match.latitude")
                ).otherwise(F.col("latitude")),
                "longitude": F.when(
                    history, F.coalesce("longitude", "match.longitude")
                ).otherwise(F.col("longitude")),
                "altitude_ft": F.when(own, F.col("altitude_ft")).otherwise(
                    metres_to_whole_feet(F.col("match.altitude_m"))
                ),
            }
        )
        .where(F.col("altitude_ft") > 0)
        .select(*reports.columns, "altitude_source")
    )


def _observation_columns(
    reports: DataFrame, distance: Column, time: Column, data_source: str = "acars"
) -> DataFrame:
    wind = wind_from_knots(
        F.col("wind_speed_kt").cast("double"), F.col("wind_dir_deg").cast("double")
    )
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return reports.withColumn("_wind", wind).select(
        F.col("seq").alias("obs_id"),
        time.alias("time"),
        F.col("flight").alias("callsign"),
        "icao",
        F.when(placed, distance).otherwise(F.lit(0.0)).alias("distance"),
        feet_to_metres(F.col("altitude_ft").cast("double")).alias("altitude"),
        "latitude",
        "longitude",
        F.col("temperature_c").cast("double").alias("temperature"),
        F.col("_wind.x").alias("wind_x"),
        F.col("_wind.y").alias("wind_y"),
        F.col("_wind.angle").alias("wind_angle"),
        F.col("_wind.speed").alias("wind_speed"),
        F.lit(S.VDL2).alias("method"),
        F.lit(data_source).alias("data_source"),
        "altitude_source",
    )


def report_observations(reports: DataFrame, live: bool = True) -> DataFrame:
    """Datalink reports as observations; altitude and temperature are required.

    The time of arrival is kept, not the time inside the message.  The live path
    uses the quick distance, replay the great-circle one.
    """
    ready = reports.where(F.col("altitude_ft").isNotNull() & F.col("temperature_c").isNotNull())
    if "altitude_source" not in ready.columns:
        ready = ready.withColumn("altitude_source", F.lit("acars"))
    place = (F.col("latitude"), F.col("longitude"))
    distance = flat_distance_km(*place) if live else haversine_km(*place)
    return _observation_columns(ready, distance, F.col("received_at"))


def weather_records(reports: DataFrame) -> DataFrame:
    """Reports with an altitude and either a temperature or a whole wind."""
    wind = F.col("wind_dir_deg").isNotNull() & F.col("wind_speed_kt").isNotNull()
    return reports.where(
        F.col("altitude_ft").isNotNull() & (F.col("temperature_c").isNotNull() | wind)
    ).select(
        "seq",
        F.coalesce("icao", F.lit("")).alias("icao"),
        F.nullif("flight", F.lit("")).alias("callsign"),
        F.col("altitude_ft").cast("double").alias("altitude_ft"),
        "latitude",
        "longitude",
        F.col("temperature_c").cast("double").alias("temperature_c"),
        F.col("wind_speed_kt").cast("double").alias("wind_speed_kt"),
        F.col("wind_dir_deg").cast("double").alias("wind_direction_deg"),
    )
