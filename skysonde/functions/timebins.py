"""Time buckets, altitude bins and clock projections."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysonde import settings as S


def time_bucket(time: Column, seconds: int) -> Column:
    """Start of the bucket holding `time`.

    Local midnight is nine hours from UTC midnight, a whole number of half-hour
    and three-hour buckets, so UTC-aligned edges are the local edges too.
    """
    return F.window(time, f"{seconds} seconds")["start"]


def half_hour_bucket(time: Column) -> Column:
    return time_bucket(time, S.HALF_HOUR_S)


def three_hour_bucket(time: Column) -> Column:
    return time_bucket(time, S.THREE_HOUR_S)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of an instant or of a UTC wall-clock time."""
    return F.unix_micros(time.cast("timestamp"))


def align_to_bucket(time: Column, seconds: int) -> Column:
    """`time` moved back to the start of its bucket, counted from local midnight.

    Plain arithmetic on the instant, usable on any single value: the zone offset
    is a whole number of hours and the bucket divides it.
    """
    width = seconds * 1_000_000
    m = micros(time)
    return F.timestamp_micros(m - F.pmod(m, F.lit(width)))


def altitude_bin(altitude: Column, width: int = S.ALTITUDE_BIN_M) -> Column:
    return (F.floor(altitude / F.lit(width)) * F.lit(width)).cast("int")


def bin_centre(altitude: Column, width: int = S.ALTITUDE_BIN_M) -> Column:
    return (F.floor(altitude / F.lit(width)) + F.lit(0.5)) * F.lit(float(width))


def wall_clock(time: Column, zone: str = S.LOCAL_ZONE) -> Column:
    """Naive local time of an instant."""
    return F.from_utc_timestamp(time.cast("timestamp"), zone).cast("timestamp_ntz")


def epoch_days(time: Column) -> Column:
    """Days since 1970 as a double."""
    return micros(time) / F.lit(86_400e6)


def age_seconds(last: Column, now: Column) -> Column:
    """Seconds from `last` to `now`, never negative; NULL when never seen."""
    gap = (micros(now) - micros(last)) / F.lit(1e6)
    return F.when(last.isNotNull(), F.greatest(F.lit(0.0), gap))
