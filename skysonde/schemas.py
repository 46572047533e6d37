"""Column layouts of the input and result tables."""

from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("obs_id", T.LongType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("icao", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("altitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("wind_x", T.DoubleType()),
        T.StructField("wind_y", T.DoubleType()),
        T.StructField("wind_angle", T.DoubleType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("data_source", T.StringType()),
        T.StructField("altitude_source", T.StringType()),
    ]
)

BDS44 = T.StructType(
    [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("wind_speed_kt", T.DoubleType()),
        T.StructField("wind_direction", T.DoubleType()),
    ]
)
BDS50 = T.StructType(
    [
        T.StructField("trackangle", T.DoubleType()),
        T.StructField("groundspeed_kt", T.DoubleType()),
        T.StructField("trueair_kt", T.DoubleType()),
    ]
)
BDS60 = T.StructType(
    [
        T.StructField("heading", T.DoubleType()),
        T.StructField("indicatedair_kt", T.DoubleType()),
        T.StructField("mach", T.DoubleType()),
    ]
)

MODES_MESSAGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("icao", T.StringType()),
        T.StructField("df", T.IntegerType()),
        T.StructField("typecode", T.IntegerType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("altitude_ft", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("bds", T.StringType()),
        T.StructField("bds44", BDS44),
        T.StructField("bds50", BDS50),
        T.StructField("bds60", BDS60),
    ]
)

VDL2_LINES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("line", T.StringType()),
    ]
)

# One datalink document.  `value` of a parameter is kept as text: only the
# location parameter is an object, others may be anything.
DATALINK = (
    "vdl2 struct<"
    "t: struct<sec: bigint, usec: bigint>,"
    "avlc: struct<"
    "src: struct<addr: string, type: string>,"
    "acars: struct<flight: string, reg: string, msg_text: string>,"
    "xid: struct<vdl_params: array<struct<name: string, value: string>>>"
    ">>"
)
AC_LOCATION = "loc struct<lat: double, lon: double>, alt int"
