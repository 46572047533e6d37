"""Weather from pairs of Mode S registers, replayed in message order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.geo import haversine_km
from skysonde.functions.physics import air_temperature_c, wind_from_knots, wind_triangle
from skysonde.functions.units import feet_to_metres, knots_to_ms
from skysonde.operators.running import SLICE_WIDTH, carry_forward
from skysonde.sources.messages import usable_fields
from skysonde.sources.storage import materialized

STATE = ("callsign", "altitude_ft", "lat", "lon", "bds50", "bds60")


def aircraft_state(messages: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Messages with the last known value of each field of their aircraft."""
    return carry_forward(usable_fields(messages), "icao", "seq", STATE, width)


def _observation(
    df: DataFrame, temperature: Column, wind: Column, distance: Column, source: str
) -> DataFrame:
    return df.withColumn("_wind", wind).select(
        F.col("seq").alias("obs_id"),
        F.col("time"),
        F.col("last_callsign").alias("callsign"),
        "icao",
        distance.alias("distance"),
        feet_to_metres(F.col("last_altitude_ft")).alias("altitude"),
        F.col("last_lat").alias("latitude"),
        F.col("last_lon").alias("longitude"),
        temperature.alias("temperature"),
        F.col("_wind.x").alias("wind_x"),
        F.col("_wind.y").alias("wind_y"),
        F.col("_wind.angle").alias("wind_angle"),
        F.col("_wind.speed").alias("wind_speed"),
        F.lit(S.MODE_S).alias("method"),
        F.lit(source).alias("data_source"),
        F.lit("adsb").alias("altitude_source"),
    )


def bds44_observations(state: DataFrame) -> DataFrame:
    """Direct weather reports with the latest altitude of the aircraft.

    The position is optional: the distance is then taken at the reference point.
    """
    ready = state.where(F.col("bds44").isNotNull() & F.col("last_altitude_ft").isNotNull())
    distance = haversine_km(
        F.coalesce("last_lat", F.lit(S.REFERENCE_LATITUDE)),
        F.coalesce("last_lon", F.lit(S.REFERENCE_LONGITUDE)),
    )
    return _observation(
        ready,
        F.col("bds44.temperature"),
        wind_from_knots(F.col("bds44.wind_speed_kt"), F.col("bds44.wind_direction")),
        distance,
        "bds44",
    )


def _with_first_check(state: DataFrame) -> DataFrame:
    """Mark, per aircraft, the first pair check made with a position at hand.

    The per-aircraft minimum is taken over one row per slice and joined back on
    (icao, _slice), the partitioning the rows already have.
    """
    check = F.col("kind").isin("bds50", "bds60", "comm_b") & F.col("last_lat").isNotNull()
    per_slice = state.groupBy("icao", "_slice").agg(
        F.min(F.when(check, F.col("seq"))).alias("_check")
    )
    gates = per_slice.select(
        "icao", "_slice", F.min("_check").over(Window.partitionBy("icao")).alias("_gate")
    )
    return state.join(gates, ["icao", "_slice"])


def paired_rows(messages: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Rows on which a track-and-speed and a heading register form a pair.

    Rule, per aircraft in message order: the two kinds of register are held, a
    newer one replaces an older one of its kind; once a position is known, the
    register that completes a pair uses up both.

    So a register either repeats the kind before it, and is then certainly held
    alone, or alternates, and then pairs up exactly when the one before was held.
    Counting from the last certain row, the odd ones complete a pair.  That count
    is a window value, carried over slices like the field values.
    """
    # Gate, slice summary and pairs all read the state: it is computed once.
    state = _with_first_check(materialized(aircraft_state(messages, width), "state"))
    gate = F.coalesce(F.col("seq") == F.col("_gate"), F.lit(False))
    gate_pairs = gate & F.col("last_bds50").isNotNull() & F.col("last_bds60").isNotNull()
    letter = F.when(F.col("bds50").isNotNull(), "a").when(F.col("bds60").isNotNull(), "b")
    # A check that pairs without bringing a register leaves nothing held.
    mark = F.coalesce(letter, F.when(gate_pairs, F.lit("x")))
    rows = (
        state.withColumns({"_mark": mark, "_gate_pair": gate_pairs})
        .where(F.col("_mark").isNotNull())
        .withColumn("_open", F.coalesce(F.col("seq") >= F.col("_gate"), F.lit(False)))
    )
    inside = Window.partitionBy("icao", "_slice").orderBy("seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumns(
        {"_rank": F.row_number().over(inside), "_previous": F.lag("_mark").over(inside)}
    )

    def certain(previous: Column) -> Column:
        """Held alone for sure, whatever was held before."""
        repeat = previous.isNull() | (previous == "x") | (previous == F.col("_mark"))
        return (F.col("_mark") != "x") & (~F.col("_open") | (repeat & ~F.col("_gate_pair")))

    sure_inside = F.col("_previous").isNotNull() & certain(F.col("_previous"))
    local = ranked.withColumns(
        {
            "_last_sure": F.max(F.when(sure_inside, F.col("_rank"))).over(so_far),
            "_is_first": F.col("_rank") == 1,
        }
    )
    summary = local.groupBy("icao", "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("_mark", "_rank").alias("_end_mark"),
        F.max("_last_sure").alias("_sure"),
        F.max(F.when(F.col("_is_first"), F.col("_mark"))).alias("_mark"),
        F.max(F.when(F.col("_is_first"), F.col("_open"))).alias("_open"),
        F.max(F.when(F.col("_is_first"), F.col("_gate_pair"))).alias("_gate_pair"),
    )
    slices = Window.partitionBy("icao").orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summary.withColumns(
            {
                "_offset": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
                "_carried_mark": F.lag("_end_mark").over(slices),
            }
        )
        .withColumn("_first_sure", certain(F.col("_carried_mark")))
        .withColumn(
            "_slice_sure",
            F.col("_offset") + F.coalesce(F.col("_sure"), F.when(F.col("_first_sure"), 1)),
        )
        .select(
            "icao",
            "_slice",
            "_offset",
            "_first_sure",
            F.max("_slice_sure").over(earlier).alias("_carried_sure"),
        )
    )
    joined = local.join(carried, ["icao", "_slice"])
    position = F.col("_offset") + F.col("_rank")
    sure = F.coalesce(
        F.col("_offset") + F.col("_last_sure"),
        F.when(F.col("_first_sure"), F.col("_offset") + 1),
        F.col("_carried_sure"),
    )
    completes = F.col("_open") & ((position - sure) % 2 == 1)
    return joined.where(F.col("_gate_pair") | F.coalesce(completes, F.lit(False))).drop(
        "_mark", "_open", "_rank", "_previous", "_last_sure", "_is_first", "_offset",
        "_first_sure", "_carried_sure", "_gate_pair", "_gate",
    )


def paired_observations(messages: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Temperature and wind from paired registers; impossible ones are dropped."""
    pairs = paired_rows(messages, width)
    air = knots_to_ms(F.col("last_bds50.trueair_kt"))
    temperature = air_temperature_c(air, F.col("last_bds60.mach"))
    place = (F.col("last_lat"), F.col("last_lon"))
    wind = wind_triangle(
        *place,
        F.col("last_bds50.trackangle"),
        knots_to_ms(F.col("last_bds50.groundspeed_kt")),
        F.col("last_bds60.heading"),
        air,
    )
    found = _observation(pairs, temperature, wind, haversine_km(*place), "bds50_60")
    return found.where(F.col("temperature") >= S.TEMPERATURE_FLOOR_C)


def replay_observations(messages: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """All weather of a Mode S replay: direct reports and paired registers."""
    return bds44_observations(aircraft_state(messages, width)).unionByName(
        paired_observations(messages, width)
    )
