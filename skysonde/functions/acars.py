"""Weather text inside datalink messages, parsed with regular expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde.functions.staging import computed_once

# --- Fixed values: message formats ---------------------------------------
# Position report, all fields joined, and the form with a gap before the speed.
WN_JOINED = r"WN(\d{5})([EW])(\d{5,6})\d{6}P?(\d{5})([MP-])(\d{2})(\d{3})(\d{2,3})"
WN_SPACED = r"WN(\d{5})([EW])(\d{5,6})\d{6}P?(\d{5})([MP-])(\d{2})(\d{3})\s+(\d{2,3})"
# Fixed-width report: spaced speed, and joined speed with a flight level.
PNTAF_SPACED = r"([NS])(\d{5})([EW])(\d{6})(\d{6})(\d{3})([MP-])(\d{2})(\d{3})\s+(\d{2})"
PNTAF_JOINED = r"([NS])(\d{5})([EW])(\d{6})(\d{6})(\d{3})([MP])(\d{2})(\d{3})(\d{2,3})"
# Flight level, optionally followed by a temperature.
FLIGHT_LEVEL = r"FL(\d{3})"
FLIGHT_LEVEL_TEMPERATURE = r"FL\d{3}\s*[/\s]?\s*([MP-])(\d{2})"
LEVEL_RANGE = (100, 500)



def captures(text: Column, pattern: str, groups: int) -> Column:
    """All groups of the first match as an array, NULL when nothing matches.

    The match is cut out once and its groups are then split in one pass, so the
    text is searched once and not once per group.
    """
    match = F.regexp_extract(text, pattern, 0)
    joined = F.regexp_replace(match, pattern, ",".join(f"${i + 1}" for i in range(groups)))
    return F.when(match != "", F.split(joined, ","))


def _int(text: Column) -> Column:
    return text.cast("int")


def _signed(sign: Column, digits: Column) -> Column:
    return F.when(sign.isin("M", "-"), -_int(digits)).otherwise(_int(digits))


def _hemisphere(letter: Column, degrees: Column) -> Column:
    return F.when(letter.isin("S", "W"), -degrees).otherwise(degrees)


def _weather(lat, lon, altitude_ft, temperature, wind_dir, wind_speed) -> Column:
    null_int = F.lit(None).cast("int")
    null_double = F.lit(None).cast("double")
    return F.struct(
        (null_double if lat is None else lat).alias("latitude"),
        (null_double if lon is None else lon).alias("longitude"),
        (null_int if altitude_ft is None else altitude_ft).alias("altitude_ft"),
        temperature.alias("temperature_c"),
        (null_int if wind_dir is None else wind_dir).alias("wind_dir_deg"),
        (null_int if wind_speed is None else wind_speed).alias("wind_speed_kt"),
    )


def wn_line(text: Column) -> Column:
    """The first line of the message that mentions WN."""
    return F.get(F.filter(F.split(text, "\r\n"), lambda part: F.contains(part, F.lit("WN"))), 0)


def wn_fields(text: Column) -> Column:
    line = wn_line(text)
    return F.coalesce(captures(line, WN_JOINED, 8), captures(line, WN_SPACED, 8))


def wn_weather(g: Column) -> Column:
    """Degrees-and-minutes report from its captured groups; NULL for 60 minutes or more."""
    lat_minutes = _int(F.substring(g[0], 3, 3)) / F.lit(10)
    lon_digits = F.substring(g[2], 4, 3)
    lon_minutes = F.when(F.length(g[2]) == 5, _int(lon_digits).cast("double")).otherwise(
        _int(lon_digits) / F.lit(10)
    )
    lat = _int(F.substring(g[0], 1, 2)) + lat_minutes / F.lit(60)
    lon = _int(F.substring(g[2], 1, 3)) + lon_minutes / F.lit(60)
    return F.when(
        g.isNotNull() & (lat_minutes < 60) & (lon_minutes < 60),
        _weather(
            lat,
            _hemisphere(g[1], lon),
            _int(g[3]),
            _signed(g[4], g[5]),
            _int(g[6]),
            _int(g[7]),
        ),
    )


def pntaf_fields(text: Column) -> Column:
    """Groups of the fixed-width report, with the kind of pattern appended."""
    spaced = captures(text, PNTAF_SPACED, 10)
    joined = captures(text, PNTAF_JOINED, 10)
    return F.coalesce(
        F.concat(spaced, F.array(F.lit("spaced"))), F.concat(joined, F.array(F.lit("joined")))
    )


def pntaf_weather(g: Column) -> Column:
    """Thousandths-of-a-degree report; only the joined form carries a flight level."""
    lat = _int(F.substring(g[1], 1, 2)) + _int(F.substring(g[1], 3, 3)) / F.lit(1000)
    lon = _int(F.substring(g[3], 1, 3)) + _int(F.substring(g[3], 4, 3)) / F.lit(1000)
    level = _int(g[5])
    altitude = F.when((g[10] == "joined") & level.between(*LEVEL_RANGE), level * 100)
    return F.when(
        g.isNotNull(),
        _weather(
            _hemisphere(g[0], lat),
            _hemisphere(g[2], lon),
            altitude,
            _signed(g[6], g[7]),
            _int(g[8]),
            _int(g[9]),
        ),
    )


def level_weather(text: Column) -> Column:
    """Flight level and, if it follows, a temperature."""
    level = F.regexp_extract(text, FLIGHT_LEVEL, 1)
    g = captures(text, FLIGHT_LEVEL_TEMPERATURE, 2)
    return F.when(
        level != "",
        _weather(
            None,
            None,
            _int(F.nullif(level, F.lit(""))) * 100,
            F.when(g.isNotNull(), _signed(g[0], g[1])),
            None,
            None,
        ),
    )


def with_weather_text(df: DataFrame, text: str = "msg_text") -> DataFrame:
    """Add `weather` (struct) and `format` from the text column.

    Formats are tried in the order WN, PNTAF, flight level.  Each pattern runs
    once per row.
    """
    t = F.col(text)
    matched = computed_once(
        df, _wn=wn_fields(t), _pntaf=pntaf_fields(t), _fl=level_weather(t)
    )
    read = computed_once(
        matched, _wn=wn_weather(F.col("_wn")), _pntaf=pntaf_weather(F.col("_pntaf"))
    )
    level_only = F.when(F.col("_fl.altitude_ft") != 0, F.col("_fl"))
    return computed_once(
        read,
        weather=F.coalesce(F.col("_wn"), F.col("_pntaf"), level_only),
        format=F.when(F.col("_wn").isNotNull(), "wn")
        .when(F.col("_pntaf").isNotNull(), "pntaf")
        .when(level_only.isNotNull(), "fl"),
    ).drop("_wn", "_pntaf", "_fl")
