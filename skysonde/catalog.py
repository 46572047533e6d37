"""Every operator as a query over the driver tables.

Tolerances of the lookups are wider than their defaults because the driver
events are sparse; they are parameters of the operators.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysonde import bridge
from skysonde import settings as S
from skysonde.functions import geo, physics, timebins, units
from skysonde.functions.identifiers import normal_identifier, strip_callsign
from skysonde.operators import (
    asof,
    compare,
    contours,
    detectors,
    fetch,
    filters,
    grid,
    monitor,
    outliers,
    pairing,
    profile,
    series,
    surface,
    winds,
)
from skysonde.plans import replay, views
from skysonde.sources import exports, landing, messages, tables
from skysonde.streaming import alarms, fragments, jobs, live
from skysonde.streaming import positions as history
from skysonde.streaming.ring import HistoryRing
from skysonde.sources.storage import fresh_folder, materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Wider reaches for the sparse driver events.
POSITION_REACH_S = 3600
XID_REACH_S = 21_600
COMPARE_REACH_S = 3600
PAIRING_TTL_S = 86_400
SECOND_ARRIVAL = "2024-01-15"
#: Tasks that keyed state is dealt to: the driver tables have few aircraft.
STATE_PARTITIONS = 4
SILENCE_LIMITS = {S.MODE_S: 1800, S.VDL2: 3600}
NOW = "2024-01-30 12:34:56"
PERIOD = ("2024-01-05 00:10:00", "2024-01-25 12:50:00")


# Means of temperatures are decimals of seven places; cutting those at six would
# leave the last digit to the order of summation.
MEAN_PLACES = 9


def query(name: str, places: int = 6) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(make(spark, sf_dir), places)
        return make

    return register


def rounded(value: Column, places: int) -> Column:
    """As `round`, half up and never negative zero.

    `round` goes through a decimal's text for each value.  Only values near a tie and those
    too large for the scaled double to tell need that.
    """
    scale = F.lit(10.0**places)
    whole = F.rint(value * scale)
    clear = (F.abs(whole) < 1e12) & (F.abs(value * scale - whole) < 0.499)
    return F.when(clear, whole / scale).otherwise(F.round(value, places)) + F.lit(0.0)


def tidy(df: DataFrame, places: int) -> DataFrame:
    """Doubles rounded (and never negative zero), for comparison."""
    return df.select(
        *[
            rounded(F.col(c), places).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def period() -> tuple[Column, Column]:
    return instant(PERIOD[0]), instant(PERIOD[1])


obs = bridge.observations


def _docs(spark, sf):
    return messages.parse_datalink(bridge.vdl2_lines(spark, sf))


def _reports(spark, sf):
    return messages.acars_reports(_docs(spark, sf))


def _half(spark, sf):
    return grid.representative_grid(obs(spark, sf), grid.HALF_HOUR_GRID)


def _three(spark, sf):
    return grid.representative_grid(obs(spark, sf), grid.THREE_HOUR_GRID)


# --- sources and sinks -------------------------------------------------------


@query("s1_modes_line_scan")
def _(spark, sf):
    return messages.modes_hex_lines(bridge.modes_lines(spark, sf)).select("seq", "hex")


def _capture(lines: DataFrame, path: str, files: int = 5) -> str:
    """Lines as text files whose names follow their order."""
    ordered = lines.repartitionByRange(files, "seq").sortWithinPartitions("seq")
    ordered.select(F.coalesce("line", F.lit("")).alias("value")).write.mode("append").text(path)
    return path


@query("s1_numbered_capture")
def _(spark, sf):
    """Usable lines of capture files numbered in file order; the datalink lines go on from them."""
    heard = messages.read_modes_capture(spark, _capture(bridge.modes_lines(spark, sf), fresh_folder(spark, "capture-modes")))
    last = materialized(heard, "heard").agg(F.max("seq").alias("seq")).first().seq or 0
    lines = _capture(bridge.vdl2_lines(spark, sf), fresh_folder(spark, "capture-datalink"))
    after = messages.read_numbered_lines(spark, lines, before=last)
    return heard.select("seq", F.col("hex").alias("text")).unionByName(after.select("seq", F.col("line").alias("text")))


@query("s2_datalink_json_scan")
def _(spark, sf):
    d = F.col("doc.vdl2.avlc")
    return _docs(spark, sf).select(
        "seq",
        d["src"]["type"].alias("sender_type"),
        d["acars"].isNotNull().alias("has_acars"),
        d["xid"].isNotNull().alias("has_xid"),
    )


@query("s3_observation_scan")
def _(spark, sf):
    return obs(spark, sf).where(F.col("distance") <= 50).select("time", "altitude", "temperature")


@query("s4_append_observations")
def _(spark, sf):
    path = fresh_folder(spark, "append")
    tables.append_observations(obs(spark, sf), path)
    return tables.read_observations(spark, path).select(
        "obs_id", "time", "callsign", "temperature", "wind_x", "method",
        F.col("date").cast("string").alias("day"),
    )


@query("s5_comparison_csv")
def _(spark, sf):
    path = fresh_folder(spark, "comparison")
    exports.write_comparison_csv(compare.comparison_records(obs(spark, sf)), path)
    return spark.read.csv(path, header=True).na.fill("")


@query("s6_discrepancy_json")
def _(spark, sf):
    pairs = compare.discrepancies(
        compare.comparison_records(obs(spark, sf)), window_s=COMPARE_REACH_S, tile=exports.DOCUMENT_TILE
    )
    path = fresh_folder(spark, "discrepancies")
    exports.write_discrepancies_json(pairs, path)
    docs = spark.read.schema(exports.discrepancy_documents(pairs).schema).options(**exports.JSON_TIMES).json(path)
    return docs.select(
        F.col("modes.timestamp").alias("modes_timestamp"),
        F.col("vdl2.timestamp").alias("vdl2_timestamp"),
        F.col("diff.time_s").alias("time_s"),
        F.col("diff.wind_dir_deg").alias("wind_dir_deg"),
    )


def _streamed(spark, frame: DataFrame, purpose: str) -> DataFrame:
    """The result of a stream read to its end, through a table in the shared folder."""
    out, mark = fresh_folder(spark, purpose), fresh_folder(spark, f"{purpose}-mark")
    (
        frame.writeStream.option("checkpointLocation", mark)
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema(frame.schema).parquet(out)


def _landed(spark, frame: DataFrame, purpose: str) -> str:
    path = fresh_folder(spark, f"land-{purpose}")
    frame.write.parquet(path)
    return path


def _zoned(frame: DataFrame, time: str) -> DataFrame:
    return frame.withColumn(time, F.col(time).cast("timestamp"))


@query("s7_landing_stream")
def _(spark, sf):
    path = _landed(spark, _zoned(bridge.modes_messages(spark, sf), "time"), "messages")
    stream = landing.stream_modes_messages(spark, path)
    routed = stream.select("seq", "icao", messages.message_kind().alias("kind"))
    return _streamed(spark, routed, "landing")


@query("s7_numbered_arrivals")
def _(spark, sf):
    """Three arrivals of text lines, numbered by a stream that starts anew for each."""
    landed, table, mark = (fresh_folder(spark, f"arrivals-{n}") for n in ("landed", "table", "mark"))
    lines = bridge.vdl2_lines(spark, sf)
    for n in range(3):
        third = lines.where(F.floor(F.col("seq") / F.lit(500)) % 3 == n)
        _capture(third, landed, 1)
        landing.number_arrivals(spark, landed, table, mark, True, files=1).awaitTermination()
    return spark.read.parquet(table).select("seq", "line")


@query("s8_naive_time_migration")
def _(spark, sf):
    moved = tables.naive_to_zoned(obs(spark, sf).select("obs_id", "time"))
    return moved.withColumn("time", F.col("time").cast("timestamp_ntz"))


# --- projections, filters, predicates -------------------------------------------


@query("p1_allowed_columns")
def _(spark, sf):
    return filters.select_allowed(obs(spark, sf), ["time", "no_such_column", "wind_x", "method"])


@query("p2_quality_filter")
def _(spark, sf):
    return filters.quality_rows(obs(spark, sf), *period()).select(
        "obs_id", "time", "altitude", "temperature"
    )


@query("p2_quality_filter_limited")
def _(spark, sf):
    return filters.quality_rows(obs(spark, sf), *period(), 80.0, 2000.0).select("obs_id")


@query("p3_grid_range_filter")
def _(spark, sf):
    return filters.grid_rows(_half(spark, sf), *period(), 2000.0).select(
        "time_bucket", "altitude_bin", "temperature"
    )


@query("p4_valid_observation")
def _(spark, sf):
    return obs(spark, sf).where(filters.is_valid_observation()).select("obs_id")


@query("p5_finite_rows")
def _(spark, sf):
    return filters.finite_rows(obs(spark, sf)).select("obs_id", "altitude", "temperature")


@query("p6_absurd_temperature_drop")
def _(spark, sf):
    return filters.drop_absurd_temperature(obs(spark, sf)).select("obs_id")


@query("p7_calm_wind_filter")
def _(spark, sf):
    return filters.windy_rows(obs(spark, sf)).select("obs_id")


@query("p7_calm_wind_filter_limited")
def _(spark, sf):
    return filters.windy_rows(obs(spark, sf), limited=True).select("obs_id")


@query("p8_altitude_bands")
def _(spark, sf):
    return filters.band_rows(obs(spark, sf)).select("obs_id", "band")


@query("p8_altitude_bands_limited")
def _(spark, sf):
    return filters.band_rows(obs(spark, sf), limited=True).select("obs_id", "band")


@query("p9_tail_window")
def _(spark, sf):
    return filters.tail_rows(obs(spark, sf)).select("obs_id", "time")


@query("p10_extended_range")
def _(spark, sf):
    span = datetime.fromisoformat(PERIOD[1]) - datetime.fromisoformat(PERIOD[0])
    start = datetime.fromisoformat(PERIOD[0]) - span * S.RANGE_EXTENSION
    end = datetime.fromisoformat(PERIOD[1]) + span * S.RANGE_EXTENSION
    rows = filters.quality_rows(obs(spark, sf), instant(str(start)), instant(str(end)))
    return rows.select("obs_id")


@query("p11_clock_columns")
def _(spark, sf):
    return filters.clock_columns(obs(spark, sf)).select("obs_id", "local_time", "day_number")


@query("p12_period_clamp")
def _(spark, sf):
    """A range around each observation against the data range, for all presets."""
    preset = F.explode(F.array(*[F.lit(d) for d in S.PERIOD_PRESETS_DAYS]))
    wanted = obs(spark, sf).select("obs_id", "time", preset.alias("days"))
    ranges = wanted.select(
        "obs_id",
        "days",
        (F.col("time") - F.make_dt_interval(days=F.col("days"))).alias("start"),
        (F.col("time") + F.expr("INTERVAL 2 DAYS")).alias("end"),
        (F.col("days") * 86_400).alias("keep_seconds"),
    )
    return monitor.clamp_ranges(ranges, obs(spark, sf)).select(
        "obs_id", "days", "clamped_start", "clamped_end", "adjusted", "valid"
    )


@query("p13_storage_form")
def _(spark, sf):
    return filters.storage_form(
        obs(spark, sf).withColumn("wind_x", F.when(F.col("wind_x") > 0, F.col("wind_x")))
    ).select("obs_id", "callsign", "temperature", "wind_x", "latitude")


@query("p14_message_routing")
def _(spark, sf):
    return bridge.modes_messages(spark, sf).select("seq", messages.message_kind().alias("kind"))


@query("p15_detail_level")
def _(spark, sf):
    """The table that serves a period of as many days as the event's value."""
    days = F.col("value")
    return bridge.events(spark, sf).select(
        "event_id", days.alias("days"), fetch.detail_level_column(days).alias("level")
    )


@query("p16_grid_fallback_empty")
def _(spark, sf):
    empty = _half(spark, sf).where(F.col("altitude") < 0)
    return fetch.grid_or_raw(empty, obs(spark, sf), *period())


@query("p16_grid_fallback_filled")
def _(spark, sf):
    return fetch.grid_or_raw(_three(spark, sf), obs(spark, sf), *period())


@query("p17_minimum_sample")
def _(spark, sf):
    return filters.minimum_sample(
        obs(spark, sf).withColumn("altitude_bin", timebins.altitude_bin(F.col("altitude"))),
        ["altitude_bin", "method"],
    )


# --- scalar functions --------------------------------------------------------------


@query("f1_unit_conversion")
def _(spark, sf):
    return bridge.events(spark, sf).select(
        "event_id",
        units.feet_to_metres(F.col("value")).alias("metres"),
        units.knots_to_ms(F.col("value")).alias("ms"),
    )


@query("f2_haversine_distance")
def _(spark, sf):
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"))
    return obs(spark, sf).select("obs_id", km.alias("km"))


@query("f3_flat_distance")
def _(spark, sf):
    km = geo.flat_distance_km(F.col("latitude"), F.col("longitude"))
    return obs(spark, sf).select("obs_id", km.alias("km"))


@query("f4_magnetic_declination")
def _(spark, sf):
    west = geo.magnetic_declination(F.col("latitude"), F.col("longitude"))
    return obs(spark, sf).select("obs_id", west.alias("declination"))


@query("f5_air_temperature")
def _(spark, sf):
    e = F.col("event_id")
    air = (e * 13 % 120 + 150).cast("double")
    mach = (e % 10).cast("double") / F.lit(10.0)
    return bridge.events(spark, sf).select(
        "event_id", physics.air_temperature_c(air, mach).alias("temperature")
    )


@query("f6_wind_triangle")
def _(spark, sf):
    e = F.col("obs_id")
    real = lambda c: c.cast("double")
    wind = physics.wind_triangle(
        F.col("latitude"),
        F.col("longitude"),
        real(e * 7 % 360),
        real(e * 11 % 150 + 150),
        real(e * 5 % 360),
        real(e * 13 % 120 + 160),
    )
    return obs(spark, sf).select("obs_id", wind.alias("w")).select("obs_id", "w.*")


@query("f7_wind_from_polar")
def _(spark, sf):
    w = physics.wind_from_polar(F.col("value"), (F.col("event_id") * 29 % 360).cast("double"))
    return bridge.events(spark, sf).select("event_id", w.alias("w")).select("event_id", "w.x", "w.y")


@query("f8_circular_difference")
def _(spark, sf):
    e = F.col("event_id")
    d = physics.circular_difference_deg(
        (e * 29 % 360).cast("double"), (e * 7 % 360).cast("double")
    )
    return bridge.events(spark, sf).select("event_id", d.alias("difference"))


def _format(spark, sf, name):
    return _reports(spark, sf).where(F.col("format") == name)


_PARSED = (
    "seq", "latitude", "longitude", "altitude_ft", "temperature_c", "wind_dir_deg", "wind_speed_kt",
)


@query("f9_wn_parser")
def _(spark, sf):
    return _format(spark, sf, "wn").select(*_PARSED)


@query("f10_pntaf_parser")
def _(spark, sf):
    return _format(spark, sf, "pntaf").select(*_PARSED)


@query("f11_flight_level_parser")
def _(spark, sf):
    return _format(spark, sf, "fl").select("seq", "altitude_ft", "temperature_c")


@query("f12_acars_format_priority")
def _(spark, sf):
    return _reports(spark, sf).select("seq", "flight", "reg", "format", "altitude_ft")


@query("f13_sender_address")
def _(spark, sf):
    return _docs(spark, sf).select("seq", messages.datalink_icao().alias("icao"))


@query("f14_xid_location")
def _(spark, sf):
    return messages.xid_reports(_docs(spark, sf)).select(
        "seq", "icao", "latitude", "longitude", "altitude_ft"
    )


@query("f15_message_time")
def _(spark, sf):
    return _docs(spark, sf).select("seq", messages.datalink_time().alias("message_time"))


@query("f16_identifiers")
def _(spark, sf):
    padded = F.concat(F.lit("  fl"), F.col("user_id").cast("string"), F.lit("__ "))
    return bridge.events(spark, sf).select(
        "event_id",
        normal_identifier(padded).alias("identifier"),
        strip_callsign(F.trim(padded)).alias("callsign"),
    )


@query("f17_half_hour_bucket")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", timebins.half_hour_bucket(F.col("time")).alias("bucket"))


@query("f18_three_hour_bucket")
def _(spark, sf):
    return obs(spark, sf).select("obs_id", timebins.three_hour_bucket(F.col("time")).alias("bucket"))


@query("f19_align_to_bucket")
def _(spark, sf):
    t = F.col("time")
    return obs(spark, sf).select(
        "obs_id",
        timebins.align_to_bucket(t, S.HALF_HOUR_S).cast("timestamp_ntz").alias("half_hour"),
        timebins.align_to_bucket(t, S.THREE_HOUR_S).cast("timestamp_ntz").alias("three_hour"),
    )


@query("f20_altitude_bin")
def _(spark, sf):
    a = F.col("altitude")
    return obs(spark, sf).select(
        "obs_id",
        timebins.altitude_bin(a).alias("altitude_bin"),
        timebins.bin_centre(a).alias("bin_centre"),
    )


@query("f21_altitude_source_label")
def _(spark, sf):
    offset = F.col("value") / F.lit(10.0) - F.lit(2.0)
    return bridge.events(spark, sf).select(
        "event_id", asof.altitude_source_label(offset).alias("altitude_source")
    )


@query("f22_imperial_observation")
def _(spark, sf):
    e = F.col("event_id")
    speed = F.when(e % 5 != 0, F.col("value"))
    direction = F.when(e % 7 != 0, (e * 29 % 360).cast("double"))
    return (
        bridge.events(spark, sf)
        .select(
            "event_id",
            units.feet_to_metres((e * 37 % 40000).cast("double")).alias("altitude"),
            physics.wind_from_knots(speed, direction).alias("w"),
        )
        .select("event_id", "altitude", F.col("w.x").alias("wind_x"), F.col("w.y").alias("wind_y"),
                F.col("w.speed").alias("wind_speed"))
    )


@query("f23_report_observations")
def _(spark, sf):
    return asof.report_observations(_reports(spark, sf)).select(
        "obs_id", "time", "callsign", "distance", "altitude", "temperature", "wind_x", "wind_speed"
    )


@query("f24_weather_records")
def _(spark, sf):
    return asof.weather_records(_reports(spark, sf))


@query("f25_toward_angle")
def _(spark, sf):
    a = physics.toward_angle_deg(F.col("wind_x"), F.col("wind_y"))
    return obs(spark, sf).select("obs_id", a.alias("toward_angle"))


@query("f26_age_seconds")
def _(spark, sf):
    return obs(spark, sf).select(
        "obs_id", timebins.age_seconds(F.col("time"), instant(NOW)).alias("age")
    )


@query("f27_whole_feet")
def _(spark, sf):
    return obs(spark, sf).select(
        "obs_id", units.metres_to_whole_feet(F.col("altitude")).alias("feet")
    )


# --- joins ------------------------------------------------------------------------------


@query("j1_nearest_time_position")
def _(spark, sf):
    return asof.nearest_by_time(
        bridge.probes(spark, sf), bridge.positions(spark, sf), window_s=POSITION_REACH_S
    ).select(
        "seq",
        F.col("match.seq").alias("position_seq"),
        F.col("match.altitude_m").alias("altitude_m"),
        "offset_s",
        "match_source",
    )


@query("j2_nearest_order_position")
def _(spark, sf):
    return asof.nearest_by_order(bridge.probes(spark, sf), bridge.positions(spark, sf)).select(
        "seq", F.col("match.seq").alias("position_seq"), "index_distance"
    )


@query("j2_backward_order_position")
def _(spark, sf):
    return asof.nearest_by_order(
        bridge.probes(spark, sf), bridge.positions(spark, sf), backward_only=True
    ).select("seq", F.col("match.seq").alias("position_seq"))


@query("j3_identifier_resolution")
def _(spark, sf):
    named = obs(spark, sf).select("obs_id", F.coalesce("callsign", F.concat(F.lit("aB"), "icao")).alias("identifier"))
    return asof.resolve_identifier(named, bridge.positions(spark, sf))


@query("j4_xid_fill")
def _(spark, sf):
    docs = _docs(spark, sf)
    return asof.xid_fill(
        messages.acars_reports(docs), messages.xid_reports(docs), XID_REACH_S
    ).select("seq", F.col("xid.seq").alias("xid_seq"), F.col("xid.altitude_ft").alias("xid_feet"))


@query("j5_altitude_cascade")
def _(spark, sf):
    docs = _docs(spark, sf)
    return asof.fill_altitude(
        messages.acars_reports(docs),
        bridge.positions(spark, sf),
        messages.xid_reports(docs),
        POSITION_REACH_S,
        XID_REACH_S,
    ).select("seq", "altitude_ft", "altitude_source", "latitude", "longitude")


@query("j5_altitude_cascade_replay")
def _(spark, sf):
    return asof.fill_altitude_by_order(
        _reports(spark, sf), bridge.positions(spark, sf)
    ).select("seq", "altitude_ft", "altitude_source", "latitude", "longitude")


_OBSERVED = (
    "obs_id", "icao", "callsign", "altitude", "distance", "temperature", "wind_x", "wind_y",
)


@query("j6_register_pairs")
def _(spark, sf):
    return pairing.paired_observations(bridge.modes_messages(spark, sf)).select(*_OBSERVED)


@query("j7_live_pairing")
def _(spark, sf):
    path = _landed(spark, _zoned(bridge.modes_messages(spark, sf), "time"), "pairing")
    stream = fragments.live_pairs(landing.stream_modes_messages(spark, path), PAIRING_TTL_S)
    return fragments.pair_observations(_streamed(spark, stream, "pairing")).select(*_OBSERVED)


@query("j8_direct_reports")
def _(spark, sf):
    state = pairing.aircraft_state(bridge.modes_messages(spark, sf))
    return pairing.bds44_observations(state).select(*_OBSERVED)


@query("j9_cross_source_discrepancies")
def _(spark, sf):
    return compare.discrepancies(
        compare.comparison_records(obs(spark, sf)), window_s=COMPARE_REACH_S
    ).select(
        "modes_obs_id", "vdl2_obs_id", "time_diff_s", "altitude_diff_m",
        "temp_diff_c", "wind_speed_diff_ms", "wind_dir_diff_deg",
    )


def _judged(spark, sf):
    return filters.drop_absurd_temperature(obs(spark, sf).where(F.col("altitude").isNotNull()))


@query("j10_altitude_neighbours", MEAN_PLACES)
def _(spark, sf):
    rows = _judged(spark, sf)
    return outliers.neighbour_statistics(rows, outliers.usable_history(rows)).select(
        "obs_id", "neighbours", "mean_temperature"
    )


# --- aggregations -----------------------------------------------------------------------


@query("a1_data_range")
def _(spark, sf):
    return monitor.data_range(obs(spark, sf))


@query("a2_last_received")
def _(spark, sf):
    return monitor.last_received(obs(spark, sf))


@query("a3_observation_counts")
def _(spark, sf):
    return monitor.observation_counts(obs(spark, sf), 24, instant(NOW))


@query("a4_grid_statistics")
def _(spark, sf):
    return monitor.grid_statistics(
        {"half_hour": _half(spark, sf), "three_hour": _three(spark, sf)}
    )


def _quality(spark, sf):
    tables_ = {"half_hour": _half(spark, sf), "three_hour": _three(spark, sf)}
    return monitor.receiver_quality(obs(spark, sf), tables_, instant(NOW))


@query("a5_receiver_quality")
def _(spark, sf):
    return _quality(spark, sf)


@query("a6_quality_metrics")
def _(spark, sf):
    return monitor.quality_metrics(_quality(spark, sf), ("half_hour", "three_hour"))


@query("a7_half_hour_grid")
def _(spark, sf):
    return _half(spark, sf)


@query("a7_three_hour_grid")
def _(spark, sf):
    return _three(spark, sf)


@query("a8_incremental_refresh")
def _(spark, sf):
    """A grid stored up to four hours before `NOW`, brought up to date by one refresh."""
    path = fresh_folder(spark, "refresh")
    rows = obs(spark, sf)
    early = rows.where(F.col("time") < instant(NOW) - F.expr("INTERVAL 4 HOURS"))
    grid.rebuild_grid(early, grid.THREE_HOUR_GRID, path)
    grid.refresh_grid(rows, grid.THREE_HOUR_GRID, path, instant(NOW).cast("timestamp"))
    return grid.read_grid(spark, path).drop("date")


@query("a8_merged_refresh")
def _(spark, sf):
    """A stored grid that two batches of new rows were merged into."""
    rows, path = obs(spark, sf), fresh_folder(spark, "merged")
    first = F.col("time") < instant(SECOND_ARRIVAL)
    odd = F.col("obs_id") % 2 == 1
    grid.rebuild_grid(rows.where(first & odd), grid.THREE_HOUR_GRID, path)
    for part in (rows.where(~first), rows.where(first & ~odd)):
        grid.merge_rows(part, grid.THREE_HOUR_GRID, path)
    return grid.read_grid(spark, path).drop("date")


@query("a9_full_rebuild")
def _(spark, sf):
    path = fresh_folder(spark, "rebuild")
    grid.rebuild_grid(obs(spark, sf), grid.HALF_HOUR_GRID, path)
    return grid.read_grid(spark, path).drop("date")


def _measures(spark, sf):
    return filters.finite_rows(filters.quality_rows(obs(spark, sf)))


@query("a10_wind_field")
def _(spark, sf):
    return winds.wind_field(filters.windy_rows(_measures(spark, sf)))


@query("a10_wind_field_limited")
def _(spark, sf):
    return winds.wind_field(filters.windy_rows(_measures(spark, sf), limited=True), limited=True)


@query("a11_temperature_profile")
def _(spark, sf):
    return profile.temperature_profile(_measures(spark, sf))


@query("a12_standard_atmosphere")
def _(spark, sf):
    return profile.standard_atmosphere(profile.temperature_profile(_measures(spark, sf)))


@query("a13_hodograph")
def _(spark, sf):
    return profile.hodograph(filters.windy_rows(_measures(spark, sf)))


@query("a14_anchored_bins", MEAN_PLACES)
def _(spark, sf):
    return series.anchored_bins(filters.band_rows(_measures(spark, sf)), "band", "temperature")


@query("a15_temperature_regression")
def _(spark, sf):
    return outliers.regression(outliers.usable_history(obs(spark, sf)))


@query("a16_neighbour_deviation", MEAN_PLACES)
def _(spark, sf):
    rows = _judged(spark, sf)
    return outliers.neighbour_statistics(rows, outliers.usable_history(rows)).select(
        "obs_id", "mean_temperature", "std_temperature"
    )


@query("a17_outlier_flags")
def _(spark, sf):
    rows = obs(spark, sf)
    return outliers.outlier_flags(rows, outliers.usable_history(rows)).select(
        "obs_id", "residual", "is_outlier"
    )


@query("a17_outliers_in_order")
def _(spark, sf):
    judged = detectors.outliers_in_order(obs(spark, sf).select(*JUDGED), ["method"], rule=SHORT_HISTORY)
    return judged.select("obs_id", "is_outlier")


@query("a18_datalink_summary")
def _(spark, sf):
    return monitor.datalink_summary(bridge.vdl2_lines(spark, sf), _reports(spark, sf))


@query("a19_position_statistics")
def _(spark, sf):
    return monitor.position_statistics(bridge.positions(spark, sf))


@query("a20_message_distribution")
def _(spark, sf):
    return monitor.message_distribution(bridge.modes_messages(spark, sf))


@query("a21_quality_rates")
def _(spark, sf):
    return monitor.quality_rates(obs(spark, sf), bridge.vdl2_lines(spark, sf), _docs(spark, sf))


@query("a22_source_counts")
def _(spark, sf):
    return compare.source_counts(compare.comparison_records(obs(spark, sf)))


# --- windows ---------------------------------------------------------------------------


@query("w1_first_per_group")
def _(spark, sf):
    return grid.first_per_group(
        obs(spark, sf), ["icao", "method"], F.desc("time"), F.desc("obs_id")
    ).select("icao", "method", "obs_id", "time")


@query("w2_last_known_values")
def _(spark, sf):
    state = pairing.aircraft_state(bridge.modes_messages(spark, sf))
    return state.select(
        "seq", "icao", "last_callsign", "last_altitude_ft", "last_lat", "last_lon",
        F.col("last_bds60.mach").alias("last_mach"),
    )


@query("w3_hodograph_segments")
def _(spark, sf):
    return profile.hodograph_segments(
        profile.hodograph(filters.windy_rows(_measures(spark, sf)))
    )


@query("w4_gap_islands")
def _(spark, sf):
    return series.gap_islands(filters.band_rows(_measures(spark, sf)), "band")


# --- sort, limit, top-k ----------------------------------------------------------------------


@query("t1_range_fetch")
def _(spark, sf):
    return fetch.fetch_range(obs(spark, sf), *period())


@query("t1_range_fetch_truncated")
def _(spark, sf):
    return fetch.was_truncated(obs(spark, sf), *period(), limit=5000)


@query("t2_measure_fetch")
def _(spark, sf):
    return fetch.fetch_measures(obs(spark, sf), *period(), wind=True)


@query("t3_latest_rows")
def _(spark, sf):
    return fetch.fetch_latest(obs(spark, sf), 500, distance_km=100.0)


@query("t4_grid_fetch_by_time")
def _(spark, sf):
    return fetch.fetch_grid_by_time(_half(spark, sf), *period())


@query("t4_grid_fetch_measures")
def _(spark, sf):
    return fetch.fetch_grid_measures(_half(spark, sf), *period())


@query("t5_merged_time_order")
def _(spark, sf):
    return replay.in_time_order(
        obs(spark, sf).withColumn("time", F.when(F.col("method") == S.VDL2, F.col("time")))
    ).select("obs_id", "time", "method")


@query("t6_fetch_summary")
def _(spark, sf):
    return fetch.fetch_summary(fetch.fetch_measures(obs(spark, sf), *period()))


@query("t6_fetch_sample")
def _(spark, sf):
    return fetch.fetch_sample(fetch.fetch_measures(obs(spark, sf), *period()))


@query("t7_discrepancy_report")
def _(spark, sf):
    return compare.discrepancy_report(
        compare.comparison_records(obs(spark, sf)), window_s=COMPARE_REACH_S
    ).select("modes_obs_id", "vdl2_obs_id", "time_diff_s", "temp_diff_c")


# --- set operations -----------------------------------------------------------------------------


@query("u1_merged_observations")
def _(spark, sf):
    merged = replay.merge_observations(
        pairing.bds44_observations(pairing.aircraft_state(bridge.modes_messages(spark, sf))),
        asof.report_observations(_reports(spark, sf), live=False),
    )
    return merged.select("obs_id", "method", "altitude", "temperature", "distance")


@query("u1_replay")
def _(spark, sf):
    lines = bridge.vdl2_lines(spark, sf).withColumn("seq", F.col("seq") + 10_000_000_000)
    return replay.replay(bridge.modes_messages(spark, sf), lines).select(
        "obs_id", "method", "data_source", "altitude", "temperature"
    )


# --- gridded surface -----------------------------------------------------------------------------


def _extent(spark, sf):
    return surface.mesh_extent(_measures(spark, sf))


@query("g1_regular_mesh")
def _(spark, sf):
    return surface.regular_mesh(_extent(spark, sf))


@query("g2_temperature_surface")
def _(spark, sf):
    return surface.temperature_surface(_measures(spark, sf), _extent(spark, sf))


@query("g2_temperature_surface_limited")
def _(spark, sf):
    return surface.temperature_surface(_measures(spark, sf), _extent(spark, sf), limited=True)


@query("g2_surface_in_hull")
def _(spark, sf):
    return surface.surface_in_hull(_measures(spark, sf), _extent(spark, sf))


@query("g3_isotherms")
def _(spark, sf):
    return surface.isotherms(
        surface.temperature_surface(_measures(spark, sf), _extent(spark, sf))
    )


@query("g3_contour_lines")
def _(spark, sf):
    return contours.contour_lines(surface.temperature_surface(_measures(spark, sf), _extent(spark, sf)))


# --- streaming -------------------------------------------------------------------------------------


@query("st1_fragment_state")
def _(spark, sf):
    path = _landed(spark, _zoned(bridge.modes_messages(spark, sf), "time"), "fragments")
    stream = fragments.live_pairs(landing.stream_modes_messages(spark, path), PAIRING_TTL_S)
    return _streamed(spark, stream, "fragments").groupBy("icao", "data_source").agg(
        F.count(F.lit(1)).alias("reports")
    )


CLOSING = "closing"


def _closed(frame: DataFrame, icao: str) -> DataFrame:
    """Rows and one of another aircraft a day later, whose time ends the wait of all others."""
    last = frame.agg((F.max("time") + F.expr("INTERVAL 1 DAY")).alias("time"))
    row = last.select(F.lit(-1).cast("bigint").alias("seq"), "time", F.lit(icao).alias("icao"))
    return frame.unionByName(row, allowMissingColumns=True)


def _nearest_stream(spark, sf, purpose: str) -> DataFrame:
    def stream(frame, name, icao):
        path = _landed(spark, _zoned(_closed(frame, icao), "time"), name)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    found = jobs.nearest_position_stream(
        stream(bridge.probes(spark, sf), "probes", CLOSING),
        stream(bridge.positions(spark, sf), "positions", f"{CLOSING}-position"),
        POSITION_REACH_S,
    )
    return _streamed(spark, found, purpose).where(F.col("icao") != CLOSING)


@query("st2_position_retention")
def _(spark, sf):
    """Per aircraft, how many weather rows still found a position in the state, and how old."""
    return _nearest_stream(spark, sf, "retention").groupBy("icao").agg(
        F.count("altitude_m").alias("matched"),
        F.count_if(F.col("altitude_m").isNull()).alias("unmatched"),
        F.max("gap_s").alias("widest_gap_s"),
    )


def _history(spark, sf, purpose: str, closing: bool) -> tuple[DataFrame, str]:
    """What a replay in three arrivals answers from the position history, and its checkpoint."""

    def arrivals(frame, name):
        path = _in_turn(spark, _closed(frame, CLOSING) if closing else frame, "time", f"{purpose}-{name}")
        return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)

    found = history.filled_from_history(
        arrivals(bridge.positions(spark, sf), "positions"),
        arrivals(bridge.named_probes(spark, sf), "probes"),
        POSITION_REACH_S,
    )
    out, mark = fresh_folder(spark, purpose), fresh_folder(spark, f"{purpose}-mark")
    with history.keyed_state(spark, STATE_PARTITIONS):
        started = found.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").start(out)
    started.awaitTermination()
    return spark.read.schema(found.schema).parquet(out), mark


@query("st2_history_answers")
def _(spark, sf):
    """Weather rows by address or callsign, each with what the stream's own history held for it."""
    answers, _mark = _history(spark, sf, "answers", True)
    return answers.select("seq", "altitude_m", "gap_s")


@query("st2_history_state")
def _(spark, sf):
    """What the history still holds after the replay: positions, and callsigns of aircraft."""
    _answers, mark = _history(spark, sf, "state", False)
    positions = history.held_state(spark, mark, "positions")
    names = history.held_state(spark, mark, "callsigns")
    held = positions.select(F.lit("position").alias("kind"), "icao", F.lit(None).cast("string").alias("callsign"), "seq", F.col("at").alias("micros"), "since")
    return held.unionByName(
        names.select(
            F.lit("callsign").alias("kind"), "icao", "callsign", F.lit(None).cast("long").alias("seq"), F.col("until").alias("micros"), "since"
        )
    )


@query("st3_nearest_position_stream")
def _(spark, sf):
    return _nearest_stream(spark, sf, "nearest").select("seq", "icao", "altitude_m", "gap_s")


@query("st4_xid_fragment_stream")
def _(spark, sf):
    path = _landed(spark, _zoned(bridge.vdl2_lines(spark, sf), "received_at"), "lines")
    docs = messages.parse_datalink(landing.stream_datalink_lines(spark, path))
    joined = fragments.fragment_stream(
        messages.acars_reports(docs), messages.xid_reports(docs), XID_REACH_S, 2 * XID_REACH_S
    )
    return _streamed(spark, joined, "xid").select("seq", "icao", "altitude_ft", "latitude")


def _observation_stream(spark, sf):
    return landing.stream_observations(
        spark, _landed(spark, _zoned(obs(spark, sf), "time"), "observations")
    )


def _stored(spark, sf):
    path, bad = fresh_folder(spark, "stored"), fresh_folder(spark, "quarantine")
    jobs.store_stream(
        _observation_stream(spark, sf),
        path,
        bad,
        fresh_folder(spark, "store-mark"),
        available_now=True,
        filter_outliers=False,
    ).awaitTermination()
    return path, bad


@query("st5_outlier_stream")
def _(spark, sf):
    """Two arrivals: the second is judged against what the first left in the table."""
    rows = _zoned(obs(spark, sf), "time")
    first = F.col("time") < F.lit(SECOND_ARRIVAL).cast("timestamp")
    landed, path = fresh_folder(spark, "arrivals"), fresh_folder(spark, "stored")
    bad, mark = fresh_folder(spark, "quarantine"), fresh_folder(spark, "store-mark")
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(landed)
        jobs.store_stream(
            landing.stream_observations(spark, landed), path, bad, mark, available_now=True
        ).awaitTermination()
    return tables.read_observations(spark, path).select("obs_id", "temperature")


#: A history that the rows of the small tables fill several times over.
SHORT_HISTORY = detectors.Rule(size=1000)
#: What a detector per method reads; other columns would only be sorted and held along.
JUDGED = ("obs_id", "time", "altitude", "temperature", "method")


@query("st5_refit_stream")
def _(spark, sf):
    """Three arrivals judged by one detector per method, whose history is stream state."""
    path = _in_turn(spark, obs(spark, sf), "time", "refit")
    stream = landing.stream_observations(spark, path, 1)
    judged = detectors.outliers_in_arrival_order(stream.select(*JUDGED), ["method"], SHORT_HISTORY)
    return _streamed(spark, judged.select("obs_id", "is_outlier"), "refit")


@query("st6_grid_upkeep")
def _(spark, sf):
    """Two arrivals stored one after the other, the grids following the table."""
    rows = _zoned(obs(spark, sf), "time")
    first = F.col("time") < F.lit(SECOND_ARRIVAL).cast("timestamp")
    landed, path = fresh_folder(spark, "arrivals"), fresh_folder(spark, "stored")
    bad, mark = fresh_folder(spark, "quarantine"), fresh_folder(spark, "store-mark")
    paths = {spec.name: fresh_folder(spark, spec.name) for spec in grid.GRIDS}
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(landed)
        jobs.store_stream(
            landing.stream_observations(spark, landed), path, bad, mark, True, False, paths
        ).awaitTermination()
    kept = grid.read_grid(spark, paths["half_hour"])
    return kept.select(
        F.col("time_bucket").cast("timestamp_ntz").alias("time_bucket"), "altitude_bin", "altitude"
    )


def _in_turn(spark, frame: DataFrame, time: str, purpose: str, parts: int = 3) -> str:
    """Rows landed in as many files as `parts`, one for each stretch of time, in turn."""
    path = fresh_folder(spark, f"land-{purpose}")
    frame = _zoned(frame, time)
    ends = frame.agg(F.min(time).alias("first"), F.max(time).alias("last")).first()
    step = (ends.last - ends.first) / parts
    for n in range(parts):
        own = F.col(time) >= F.lit(ends.first + step * n)
        if n < parts - 1:
            own = own & (F.col(time) < F.lit(ends.first + step * (n + 1)))
        # one file each, whose rows are made by all tasks
        frame.where(own).repartition(1).write.mode("append").parquet(path)
    return path


@query("live_collection")
def _(spark, sf):
    """Positions, Mode S messages and datalink lines collected in several batches each."""
    store = live.LiveTables(fresh_folder(spark, "live"))
    places = _landed(spark, _zoned(bridge.positions(spark, sf), "time"), "positions")
    positions = spark.readStream.schema(spark.read.parquet(places).schema).parquet(places)
    heard = _in_turn(spark, bridge.modes_messages(spark, sf), "time", "heard")
    lines = _in_turn(spark, bridge.vdl2_lines(spark, sf), "received_at", "lines")
    live.collect_positions(positions, store, True).awaitTermination()
    live.collect_modes(
        landing.stream_modes_messages(spark, heard, 1), store, PAIRING_TTL_S, True, False
    ).awaitTermination()
    live.collect_datalink(
        landing.stream_datalink_lines(spark, lines, 1), store, POSITION_REACH_S, XID_REACH_S, True, False
    ).awaitTermination()
    return tables.read_observations(spark, store.path("observations")).select(
        "obs_id", "method", "altitude", "temperature"
    )


@query("st9_stored_ring")
def _(spark, sf):
    """The ring after two arrivals: the second was judged by what the first left in it."""
    rows = _zoned(obs(spark, sf), "time")
    first = F.col("time") < F.lit(SECOND_ARRIVAL).cast("timestamp")
    landed, path = fresh_folder(spark, "arrivals"), fresh_folder(spark, "stored")
    bad, mark = fresh_folder(spark, "quarantine"), fresh_folder(spark, "store-mark")
    ring = HistoryRing(fresh_folder(spark, "ring"), size=300, compact_after=2)
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(landed)
        jobs.store_stream(
            landing.stream_observations(spark, landed), path, bad, mark, available_now=True, ring=ring
        ).awaitTermination()
    return ring.rows(spark).select("obs_id", "altitude", "temperature")


@query("st7_freshness")
def _(spark, sf):
    return monitor.freshness(obs(spark, sf), instant(NOW), F.lit(21))


@query("st7_absence_alarms")
def _(spark, sf):
    """Silences of both methods that a replay in three arrivals raises alarms for."""
    path = _in_turn(spark, obs(spark, sf), "time", "alarms")
    raised = alarms.absence_alarms(landing.stream_observations(spark, path, 1), SILENCE_LIMITS, by_clock=False)
    with history.keyed_state(spark, STATE_PARTITIONS):
        out = _streamed(spark, raised, "alarms")
    return out.select("method", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_received", "due")])


@query("st8_quarantine")
def _(spark, sf):
    path, bad = _stored(spark, sf)
    stored = tables.read_observations(spark, path).select("obs_id", F.lit("stored").alias("sink"))
    return stored.unionByName(
        spark.read.parquet(bad).select("obs_id", F.lit("quarantine").alias("sink"))
    )


@query("st9_bounded_history")
def _(spark, sf):
    return outliers.latest_history(obs(spark, sf), 300).select("obs_id", "altitude", "temperature")


# --- views -----------------------------------------------------------------------------------------


#: Periods that each level of detail serves; the last covers all of the driver events.
PERIODS = {
    "raw": (datetime(2024, 1, 8), datetime(2024, 1, 15)),
    "half_hour": (datetime(2024, 1, 1), datetime(2024, 1, 31)),
    "three_hour": (datetime(2023, 11, 1), datetime(2024, 2, 29)),
}


def stored_grid(spark, sf, level: str) -> DataFrame:
    """A grid as a table of its own, written before it is viewed."""
    return materialized(_half(spark, sf) if level == "half_hour" else _three(spark, sf), level)


def view_query(name: str, level: str = "half_hour", limited: bool = False, stored: bool = True) -> Query:
    """A view of a period that `level` serves, over a stored grid or one that is computed."""

    def make(spark, sf):
        grids = {}
        if level != "raw":
            plain = _half if level == "half_hour" else _three
            grids[level] = stored_grid(spark, sf, level) if stored else plain(spark, sf)
        return views.view(name, views.Request(obs(spark, sf), *PERIODS[level], grids, limited))

    return make


for _number, _name in enumerate(views.VIEWS, 1):
    _places = MEAN_PLACES if _name == "temperature" else 6
    _short = _name in ("temperature_profile", "hodograph")
    query(f"v{_number}_{_name}", _places)(view_query(_name, stored=not _short))
    query(f"v{_number}_{_name}_limited", _places)(view_query(_name, limited=True, stored=not _short))
    if not _short:
        for _level in ("raw", "three_hour"):
            query(f"v{_number}_{_name}_{_level}", _places)(view_query(_name, _level))
