"""Observation, position and message tables derived from the `events` table.

The driver tables hold no aviation data.  Every column below is integer or plain
double arithmetic on `events`, so any SQL engine derives the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.physics import from_angle_deg


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _mod(n: int, times: int = 1) -> Column:
    return (F.col("event_id") * F.lit(times)) % F.lit(n)


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _icao() -> Column:
    return _digits(F.col("user_id") % 25, 8)


def _altitude() -> Column:
    metres = (_mod(13500, 7919) - 100).cast("double")
    return F.when(_mod(29) != 0, metres)


def _temperature() -> Column:
    field = (
        F.lit(15.0) - F.lit(0.0065) * _altitude() + (F.col("value") - F.lit(50.0)) / F.lit(10.0)
    )
    return F.when(_mod(97) == 0, F.lit(-150.0)).otherwise(field)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event."""
    x = F.col("wind_x")
    y = F.col("wind_y")
    vdl2 = F.col("event_type").isin("error", "signup")
    return (
        events(spark, sf_dir)
        .withColumns(
            {
                "wind_x": (_mod(81, 11) - 40).cast("double"),
                "wind_y": (_mod(81, 23) - 40).cast("double"),
            }
        )
        .select(
            F.col("event_id").alias("obs_id"),
            F.col("ts").alias("time"),
            F.when(
                _mod(17) != 0, F.concat(F.lit("FL"), (F.col("user_id") % 100).cast("string"))
            ).alias("callsign"),
            _icao().alias("icao"),
            _mod(120, 31).cast("double").alias("distance"),
            _altitude().alias("altitude"),
            (F.lit(35.0) + _mod(1000, 13) / F.lit(1000.0)).alias("latitude"),
            (F.lit(139.0) + _mod(1000, 17) / F.lit(1000.0)).alias("longitude"),
            _temperature().alias("temperature"),
            x.alias("wind_x"),
            y.alias("wind_y"),
            from_angle_deg(x, y).alias("wind_angle"),
            F.sqrt(x * x + y * y).alias("wind_speed"),
            F.when(vdl2, S.VDL2).otherwise(S.MODE_S).alias("method"),
            F.when(vdl2, "acars").otherwise("bds44").alias("data_source"),
            F.when(vdl2, "acars").otherwise("adsb").alias("altitude_source"),
        )
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports: the Mode S observations with a positive altitude.

    Addresses and callsigns come in both cases and with blanks, as receivers print them.
    """
    even, third = F.col("obs_id") % 2 == 0, F.col("obs_id") % 3 == 0
    address = F.when(even, F.concat(F.lit("ab"), "icao")).otherwise(
        F.concat(F.lit(" AB"), "icao", F.lit(" "))
    )
    name = F.when(third, F.lower("callsign")).otherwise(F.concat("callsign", F.lit(" ")))
    return (
        observations(spark, sf_dir)
        .where((F.col("method") == S.MODE_S) & (F.col("altitude") > 0))
        .select(
            F.col("obs_id").alias("seq"),
            "time",
            address.alias("icao"),
            name.alias("callsign"),
            F.col("altitude").alias("altitude_m"),
            "latitude",
            "longitude",
        )
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather rows that look for a position: the VDL2 observations."""
    return observations(spark, sf_dir).where(F.col("method") == S.VDL2).select(
        F.col("obs_id").alias("seq"), "time", F.concat(F.lit("aB"), "icao").alias("icao")
    )


def named_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `probes`, but every fourth has a callsign in place of its address."""
    rows = observations(spark, sf_dir).where(F.col("method") == S.VDL2)
    fourth = F.col("obs_id") % 4 == 0
    return rows.select(
        F.col("obs_id").alias("seq"),
        "time",
        F.when(~fourth, F.concat(F.lit("aB"), "icao")).alias("icao"),
        F.when(fourth, F.lower("callsign")).alias("callsign"),
    )


def vdl2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The VDL2 events printed as JSON lines, with some junk lines among them.

    The message text takes the WN, PNTAF or flight-level form in turn; every
    fifth line is an XID report.
    """
    e = F.col("event_id")
    celsius = F.coalesce(
        F.floor(_temperature()).cast("bigint"), (_mod(60) - 50).cast("bigint")
    )
    sign_m = F.when(celsius < 0, "M").otherwise("P")
    sign_dash = F.when(celsius < 0, "-").otherwise("P")
    degrees = _digits(F.abs(celsius) % 100, 2)
    feet = F.greatest(
        F.coalesce(F.floor(_altitude() / F.lit(S.FEET_TO_METRES)).cast("bigint"), F.lit(0)),
        F.lit(0),
    )
    direction = _digits(_mod(360, 7), 3)
    knots = _digits(_mod(140, 3) + 10, 2)
    minutes_lat = _digits(_mod(640, 13), 3)
    clock = _digits(_mod(1000000, 37), 6)

    wn = F.concat(
        F.lit("POS REPORT\\r\\nWN35"),
        minutes_lat,
        F.lit("E139"),
        F.when(_mod(2) == 0, _digits(_mod(60, 17), 2)).otherwise(_digits(_mod(600, 17), 3)),
        clock,
        F.when(_mod(7) == 0, "P").otherwise(""),
        _digits(feet, 5),
        sign_dash,
        degrees,
        direction,
        F.when(_mod(11) == 0, " ").otherwise(""),
        knots,
        F.when(_mod(11) == 0, " 99").otherwise("005200"),
        F.lit("\\r\\nEND"),
    )
    pntaf_head = F.concat(
        F.lit("PNTAF "),
        F.when(_mod(13) == 0, "S").otherwise("N"),
        F.lit("35"),
        _digits(_mod(1000, 13), 3),
        F.lit("E139"),
        _digits(_mod(1000, 17), 3),
        clock,
        _digits(F.floor(feet / 100), 3),
    )
    pntaf = F.when(
        F.floor(e / 3) % 2 == 0,
        F.concat(pntaf_head, sign_m, degrees, direction, knots, F.lit("086")),
    ).otherwise(F.concat(pntaf_head, sign_m, degrees, direction, F.lit(" "), knots, F.lit(" 106")))
    level = F.concat(
        F.lit("REQ FL"),
        _digits(F.floor(feet / 100), 3),
        F.when(_mod(4) == 0, F.concat(F.lit(" "), sign_m, degrees))
        .when(_mod(4) == 1, F.concat(F.lit("/"), sign_m, degrees))
        .otherwise(""),
    )
    text = F.when(_mod(3) == 0, wn).when(_mod(3) == 1, pntaf).otherwise(level)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    head = F.concat(
        F.lit('{"vdl2":{"t":{"sec":'),
        F.floor(micros / 1_000_000).cast("string"),
        F.lit(',"usec":'),
        (micros % 1_000_000).cast("string"),
        F.lit('},"avlc":{"src":{"addr":"'),
        F.when(_mod(19) == 0, "").otherwise(F.concat(F.lit("Ab"), _icao())),
        F.lit('","type":"Aircraft"},'),
    )
    acars = F.concat(
        F.lit('"acars":{"flight":"FL'),
        (F.col("user_id") % 100).cast("string"),
        F.lit('","reg":"JA'),
        (F.col("user_id") % 1000).cast("string"),
        F.lit('","msg_text":"'),
        text,
        F.lit('"}}}}'),
    )
    xid = F.concat(
        F.lit('"xid":{"vdl_params":[{"name":"hop","value":1},{"name":"ac_location","value":'),
        F.lit('{"loc":{"lat":35.'),
        _digits(_mod(1000, 13), 3),
        F.lit(',"lon":139.'),
        _digits(_mod(1000, 17), 3),
        F.lit("}"),
        F.when(_mod(3) != 2, F.concat(F.lit(',"alt":'), feet.cast("string"))).otherwise(""),
        F.lit("}}]}}}}"),
    )
    line = (
        F.when(_mod(41) == 0, F.lit('{"vdl2":{"t":'))
        .when(_mod(43) == 0, F.lit("[1,2,3]"))
        .when(_mod(5) == 0, F.concat(head, xid))
        .otherwise(F.concat(head, acars))
    )
    return (
        events(spark, sf_dir)
        .where(F.col("event_type").isin("error", "signup"))
        .select(e.alias("seq"), F.col("ts").alias("received_at"), line.alias("line"))
    )


def modes_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded Mode S messages: the events spread over five kinds."""
    kind = _mod(5)

    def real(value: Column) -> Column:
        return value.cast("double")

    other = _mod(7) == 6
    bds = (
        F.when(other & (kind >= 3), F.lit("17"))
        .when(kind == 2, "44")
        .when(kind == 3, "50")
        .when(kind == 4, "60")
    )
    b44 = F.struct(
        F.when(_mod(37) != 0, _temperature()).alias("temperature"),
        real(_mod(120, 3)).alias("wind_speed_kt"),
        real(_mod(360, 29)).alias("wind_direction"),
    )
    b50 = F.struct(
        real(_mod(360, 7)).alias("trackangle"),
        F.when(_mod(31) != 0, real(_mod(150, 11) + 350)).alias("groundspeed_kt"),
        real(_mod(120, 13) + 380).alias("trueair_kt"),
    )
    b60 = F.struct(
        real(_mod(360, 5)).alias("heading"),
        real(_mod(60) + 250).alias("indicatedair_kt"),
        F.when(_mod(23) == 4, F.lit(0.0))
        .otherwise(real(_mod(30, 17) + 60) / F.lit(100.0))
        .alias("mach"),
    )
    located = _mod(47) != 0
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("time"),
        _icao().alias("icao"),
        F.when(kind == 0, F.when(_mod(2) == 0, 17).otherwise(18))
        .when(kind == 1, 17)
        .otherwise(F.when(_mod(2) == 0, 20).otherwise(21))
        .cast("int")
        .alias("df"),
        F.when(kind == 0, F.lit(9) + _mod(15))
        .when(kind == 1, F.lit(1) + _mod(4))
        .cast("int")
        .alias("typecode"),
        F.when(
            kind == 1, F.concat(F.lit("FL"), (F.col("user_id") % 100).cast("string"), F.lit("__"))
        ).alias("callsign"),
        F.when(kind == 0, F.floor(_altitude() / F.lit(S.FEET_TO_METRES)).cast("double")).alias(
            "altitude_ft"
        ),
        F.when((kind == 0) & located, F.lit(35.0) + _mod(1000, 13) / F.lit(1000.0)).alias("lat"),
        F.when((kind == 0) & located, F.lit(139.0) + _mod(1000, 17) / F.lit(1000.0)).alias("lon"),
        bds.alias("bds"),
        F.when(bds == "44", b44).alias("bds44"),
        F.when(bds == "50", b50).alias("bds50"),
        F.when(bds == "60", b60).alias("bds60"),
    )


def modes_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw Mode S text lines: proper ones, short ones, padded ones and noise."""
    kind = _mod(6)

    def digits(width: int) -> Column:
        return F.lpad(F.hex(F.col("event_id")), width, "8")

    line = (
        F.when(kind == 0, digits(28))
        .when(kind == 1, F.concat(F.lit("*"), digits(22), F.lit(";")))
        .when(kind == 2, F.concat(F.lit("*"), digits(28), F.lit(";")))
        .when(kind == 3, F.concat(F.lit("*"), digits(14), F.lit(";")))
        .when(kind == 4, F.concat(F.lit("  *"), digits(28), F.lit("; ")))
        .otherwise("")
    )
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), line.alias("line"))
