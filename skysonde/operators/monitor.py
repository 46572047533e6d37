"""Data range, reception quality, content statistics and freshness."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.identifiers import normal_identifier
from skysonde.functions.staging import computed_once
from skysonde.functions.timebins import age_seconds, micros
from skysonde.sources.messages import message_kind


def data_range(observations: DataFrame) -> DataFrame:
    return observations.agg(
        F.min("time").alias("earliest"),
        F.max("time").alias("latest"),
        F.count(F.lit(1)).alias("count"),
    )


def _per_method(observations: DataFrame, **measures: Callable[[Column], Column]) -> DataFrame:
    """One row per known method, also for a method without rows.

    The methods are two constants, so conditional aggregates in one ungrouped
    pass do without a join to a method list.
    """
    seen = observations.where(F.col("method").isin(*S.METHODS))
    wide = seen.agg(
        *[
            measure(F.col("method") == method).alias(f"{name}_{i}")
            for i, method in enumerate(S.METHODS)
            for name, measure in measures.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(method).alias("method"),
                *[F.col(f"{name}_{i}").alias(name) for name in measures],
            )
            for i, method in enumerate(S.METHODS)
        ]
    )
    return wide.select(F.inline(rows))


def last_received(observations: DataFrame) -> DataFrame:
    return _per_method(
        observations, last_received=lambda mine: F.max(F.when(mine, F.col("time")))
    )


def _since(now: Column, hours: int) -> Column:
    return now - F.expr(f"INTERVAL {hours} HOURS")


def observation_counts(observations: DataFrame, hours: int, now: Column) -> DataFrame:
    recent = observations.where(F.col("time") >= _since(now, hours))
    return _per_method(recent, count=lambda mine: F.count_if(mine))


def grid_statistics(grids: dict[str, DataFrame | None]) -> DataFrame:
    """Row count and bucket extent per grid; a missing grid is flagged."""
    result = None
    for name, grid in grids.items():
        if grid is None:
            template = next(g for g in grids.values() if g is not None)
            stats = template.limit(0).agg(
                F.count(F.lit(1)).alias("row_count"),
                F.min("time_bucket").alias("earliest"),
                F.max("time_bucket").alias("latest"),
            )
        else:
            stats = grid.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.min("time_bucket").alias("earliest"),
                F.max("time_bucket").alias("latest"),
            )
        row = stats.select(
            F.lit(name).alias("grid"),
            "row_count",
            "earliest",
            "latest",
            F.lit(grid is None).alias("error"),
        )
        result = row if result is None else result.unionByName(row)
    return result


def receiver_quality(
    observations: DataFrame, grids: dict[str, DataFrame], now: Column
) -> DataFrame:
    """Per method: counts of the last hour and day, last reception, age; grid sizes.

    The observations are read once, each grid once.
    """
    hour, day = _since(now, 1), _since(now, 24)
    methods = _per_method(
        observations,
        last_hour=lambda mine: F.count_if(mine & (F.col("time") >= hour)),
        last_24h=lambda mine: F.count_if(mine & (F.col("time") >= day)),
        last_received=lambda mine: F.max(F.when(mine, F.col("time"))),
    ).withColumn("age_seconds", age_seconds(F.col("last_received"), now))
    sizes = {
        f"{name}_rows": grid.agg(F.count(F.lit(1)).alias("n")).scalar()
        for name, grid in grids.items()
    }
    return methods.withColumns(sizes)


def quality_metrics(quality: DataFrame, grids: tuple[str, ...]) -> DataFrame:
    """The snapshot in long form; a method never seen has no age row."""

    def metric(name: str, label: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), label.alias("label"), value.cast("double").alias("value")
        )

    method = F.col("method")
    per_method = quality.select(
        F.inline(
            F.array(
                metric("observations_total", method, F.col("last_24h")),
                metric("observations_last_hour", method, F.col("last_hour")),
                metric("last_observation_age_seconds", method, F.bround("age_seconds")),
            )
        )
    ).where(F.col("value").isNotNull())
    per_grid = quality.where(method == S.MODE_S).select(
        F.inline(
            F.array(*[metric("aggregate_rows", F.lit(g), F.col(f"{g}_rows")) for g in grids])
        )
    )
    return per_method.unionByName(per_grid)


def datalink_summary(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """How many messages there are and what their weather holds."""
    wind = F.col("wind_dir_deg").isNotNull() & F.col("wind_speed_kt").isNotNull()
    altitude = F.col("altitude_ft").isNotNull()
    temperature = F.col("temperature_c").isNotNull()
    total = lines.agg(F.count(F.lit(1)).alias("n")).scalar()
    return reports.agg(
        F.count(F.lit(1)).alias("weather_messages"),
        F.count_if(altitude).alias("with_altitude"),
        F.count_if(temperature).alias("with_temperature"),
        F.count_if(wind).alias("with_wind"),
        F.count_if(altitude & temperature).alias("complete_records"),
    ).withColumn("total_messages", total)


def position_statistics(positions: DataFrame) -> DataFrame:
    """Aircraft, history entries and callsign mappings of the position history.

    Distinct values are grouped first, so no task holds all of them.
    """
    aircraft = normal_identifier(F.col("icao"))
    rows = positions.where(aircraft.isNotNull())
    per_aircraft = rows.groupBy(aircraft.alias("icao")).agg(F.count(F.lit(1)).alias("entries"))
    names = (
        rows.select(normal_identifier(F.col("callsign")).alias("name"))
        .where(F.col("name").isNotNull())
        .distinct()
        .agg(F.count(F.lit(1)).alias("n"))
        .scalar()
    )
    return per_aircraft.agg(
        F.count(F.lit(1)).alias("aircraft_count"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("total_entries"),
    ).withColumns({"callsign_mappings": names, "message_counter": F.col("total_entries")})


def message_distribution(messages: DataFrame) -> DataFrame:
    """Counts per downlink format, per type code and per register, in one pass."""
    kind = message_kind()
    register = F.when(
        F.col("df").isin(20, 21),
        F.when(kind == "bds44", "BDS44")
        .when(kind == "bds50", "BDS50")
        .when(kind == "bds60", "BDS60")
        .otherwise("other"),
    )

    def entry(dimension: str, value: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))

    entries = F.array(
        entry("df", F.col("df").cast("string")),
        entry("typecode", F.when(F.col("df").isin(17, 18), F.col("typecode").cast("string"))),
        entry("bds", register),
    )
    return (
        messages.select(F.inline(entries))
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


# --- Fixed values: plausible ranges of the data-quality check ---
PLAUSIBLE_TEMPERATURE_C = (-100, 50)
PLAUSIBLE_ALTITUDE_M = (0, 20_000)


def quality_rates(observations: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of lines that do not parse and of observations in a plausible range."""
    t, a = F.col("temperature"), F.col("altitude")
    plausible = (
        (t > PLAUSIBLE_TEMPERATURE_C[0])
        & (t < PLAUSIBLE_TEMPERATURE_C[1])
        & (a > PLAUSIBLE_ALTITUDE_M[0])
        & (a < PLAUSIBLE_ALTITUDE_M[1])
    )
    count = F.count(F.lit(1)).alias("n")
    total = lines.agg(count).scalar()
    parsed = docs.agg(count).scalar()
    return observations.agg(
        F.avg(F.coalesce(plausible, F.lit(False)).cast("double")).alias("valid_share")
    ).withColumn("parse_error_share", F.lit(1.0) - parsed / F.nullif(total, F.lit(0)))


def freshness(observations: DataFrame, now: Column, local_hour: Column) -> DataFrame:
    """Per method: age, whether it is over the alarm limit and over the display limit."""
    start, end = S.DAY_HOURS
    by_day = (local_hour >= start) & (local_hour < end)
    vdl2 = F.col("method") == S.VDL2
    limit = F.when(vdl2, S.FRESH_VDL2_S).when(by_day, S.FRESH_DAY_S).otherwise(S.FRESH_NIGHT_S)
    shown = F.when(vdl2, S.STALE_VDL2_S).otherwise(S.STALE_MODE_S_S)
    minutes = F.floor((micros(now) - micros(F.col("last_received"))) / F.lit(60_000_000))
    return last_received(observations).select(
        "method",
        "last_received",
        age_seconds(F.col("last_received"), now).alias("age_seconds"),
        limit.alias("limit_seconds"),
        F.coalesce(age_seconds(F.col("last_received"), now) > limit, F.lit(True)).alias("failed"),
        F.coalesce(minutes >= shown / 60, F.lit(True)).alias("stale"),
    )


def clamp_ranges(ranges: DataFrame, observations: DataFrame) -> DataFrame:
    """Requested ranges cut to the data, keeping the period where the data allows.

    `ranges` has `start`, `end` and optionally `keep_seconds`.  Bounds are whole
    minutes.  `adjusted` tells that something moved, `valid` that start <= end.
    """
    extent = data_range(observations).select(F.struct("earliest", "latest")).scalar()
    d = F.col("_d")

    def minute(time: Column) -> Column:
        return F.date_trunc("minute", time).cast("timestamp_ntz")

    asked = computed_once(
        ranges, _d=extent, _s=minute(F.col("start")), _e=minute(F.col("end"))
    )
    late = F.coalesce(F.col("_e") > d["latest"], F.lit(False))
    early = F.coalesce(F.col("_s") < d["earliest"], F.lit(False))
    cut = computed_once(
        asked,
        _cut=late | early,
        _s=F.when(early, minute(d["earliest"])).otherwise(F.col("_s")),
        _e=F.when(late, minute(d["latest"])).otherwise(F.col("_e")),
    )
    back = F.col("_e") - F.make_dt_interval(secs=F.col("keep_seconds"))
    kept = computed_once(
        cut, _back=F.when(F.coalesce(back >= d["earliest"], F.lit(False)), minute(back))
    )
    begin = F.coalesce("_back", "_s")
    return kept.select(
        *ranges.columns,
        begin.alias("clamped_start"),
        F.col("_e").alias("clamped_end"),
        (F.col("_cut") | (begin != F.col("_s"))).alias("adjusted"),
        (begin <= F.col("_e")).alias("valid"),
    )
