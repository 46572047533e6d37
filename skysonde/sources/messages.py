"""Message sources: Mode S lines and VDL2 JSON lines."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysonde import schemas
from skysonde.functions.acars import with_weather_text
from skysonde.functions.identifiers import strip_callsign
from skysonde.functions.staging import computed_once
from skysonde.sources.storage import materialized

MIN_MESSAGE_DIGITS = 22


def read_text_lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    """Text files as one column; `read_numbered_lines` also gives their order."""
    return spark.read.text(path).select(F.col("value").alias(column))


#: Lines lie in blocks of a file; up to so many blocks, 100 bytes each, are broadcast.
BROADCAST_BLOCKS = 500_000
_PLACE = ("_arrived", "_file", "_block")


def with_place(lines: DataFrame) -> DataFrame:
    """Lines of text files with where they stand: file, block of it, and order in the block.

    A block of a file is read by one task from its start on, so that ids grow along it.
    """
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_modification_time").alias("_arrived"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def numbered_in_place(lines: DataFrame, order: tuple[str, ...], before: int | Column = 0) -> DataFrame:
    """Lines of `with_place` with `seq`, from `before` + 1 on without gaps, in the order of their places.

    No line moves: lines are counted per block, and each block starts where those before it
    end.  They are written first, so that blocks are cut once and for all.
    """
    rows = materialized(lines.withColumn("_id", F.monotonically_increasing_id()), "lines")
    blocks = rows.groupBy(*_PLACE).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    start = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + before
    starts = materialized(blocks.withColumn("_start", start).drop("_n"), "blocks")
    if starts.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    placed = rows.join(starts, list(_PLACE))
    return placed.select((F.col("_start") + F.col("_id") - F.col("_first") + 1).alias("seq"), "line")


def read_numbered_lines(
    spark: SparkSession, path: str | list[str], kept: Column | None = None, before: int | Column = 0
) -> DataFrame:
    """(seq, line) of text files: a running number over the lines that are `kept`, by file name and line.

    `before` goes on from another file's lines, as a capture of both methods counts them.
    """
    lines = with_place(spark.read.text(path))
    if kept is not None:
        lines = lines.where(kept)
    return numbered_in_place(lines, ("_file", "_block"), before)


def read_modes_capture(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq, line, hex) of the usable lines of Mode S capture files, numbered in file order."""
    text = F.trim(F.col("line"))
    digits = F.length(F.rtrim(F.substring(text, 2, 2_147_483_647), F.lit(";")))
    return modes_hex_lines(read_numbered_lines(spark, path, F.startswith(text, F.lit("*")) & (digits >= MIN_MESSAGE_DIGITS)))


def modes_hex_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw Mode S lines `*<hex>;` reduced to their hex text.

    Lines that do not start with `*` or hold too few digits are dropped.
    """
    text = F.trim(F.col(line))
    kept = lines.where(F.startswith(text, F.lit("*")))
    stripped = F.rtrim(F.substring(text, 2, 2_147_483_647), F.lit(";"))
    return kept.withColumn("hex", stripped).where(F.length("hex") >= MIN_MESSAGE_DIGITS)


def message_kind() -> Column:
    """Routing of a decoded Mode S message by format, type code and register."""
    df, code, bds = F.col("df"), F.col("typecode"), F.col("bds")
    squitter = df.isin(17, 18)
    comm_b = df.isin(20, 21)
    return (
        F.when(squitter & code.between(1, 4), "callsign")
        .when(squitter & (code.between(5, 18) | code.between(20, 22)), "position")
        .when(comm_b & (bds == "44"), "bds44")
        .when(comm_b & (bds == "50"), "bds50")
        .when(comm_b & (bds == "60"), "bds60")
        .when(comm_b, "comm_b")
    )


def _complete(column: str, fields: tuple[str, ...]) -> Column:
    whole = F.lit(True)
    for field in fields:
        whole = whole & F.col(f"{column}.{field}").isNotNull()
    return whole


def usable_fields(messages: DataFrame) -> DataFrame:
    """Messages with `kind`, keeping only field values a receiver would take over.

    Altitude must be positive and a coordinate pair whole; a register counts only
    when all its fields were decoded.
    """
    m = messages.withColumn("kind", message_kind())
    is_position = (F.col("kind") == "position") & (F.col("altitude_ft") > 0)
    located = is_position & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    full44 = _complete("bds44", ("temperature", "wind_speed_kt", "wind_direction"))
    full50 = _complete("bds50", ("trackangle", "groundspeed_kt", "trueair_kt"))
    full60 = _complete("bds60", ("heading", "indicatedair_kt", "mach"))
    name = F.nullif(strip_callsign(F.col("callsign")), F.lit(""))
    return m.select(
        "seq",
        "time",
        "icao",
        "kind",
        F.when(F.col("kind") == "callsign", name).alias("callsign"),
        F.when(is_position, F.col("altitude_ft")).alias("altitude_ft"),
        F.when(located, F.col("lat")).alias("lat"),
        F.when(located, F.col("lon")).alias("lon"),
        F.when((F.col("kind") == "bds44") & full44, F.col("bds44")).alias("bds44"),
        F.when((F.col("kind") == "bds50") & full50, F.col("bds50")).alias("bds50"),
        F.when((F.col("kind") == "bds60") & full60, F.col("bds60")).alias("bds60"),
    )


def parse_datalink(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines as a `doc` struct; broken JSON and non-objects are dropped."""
    parsed = computed_once(lines, doc=F.from_json(F.col(line), schemas.DATALINK))
    return parsed.where(F.col("doc.vdl2").isNotNull()).drop(line)


def datalink_icao() -> Column:
    return F.nullif(F.col("doc.vdl2.avlc.src.addr"), F.lit(""))


def datalink_time() -> Column:
    """Time inside the message; NULL when the seconds are missing or zero."""
    t = F.col("doc.vdl2.t")
    micros = t["sec"] * 1_000_000 + F.coalesce(t["usec"], F.lit(0))
    return F.when(t["sec"] != 0, F.timestamp_micros(micros)).cast("timestamp_ntz")


def xid_reports(docs: DataFrame) -> DataFrame:
    """Aircraft location reports; sender and altitude are required."""
    params = F.col("doc.vdl2.avlc.xid.vdl_params")
    first = F.get(F.filter(params, lambda p: p["name"] == "ac_location"), 0)
    return (
        computed_once(docs, _location=F.from_json(first["value"], schemas.AC_LOCATION))
        .withColumn("icao", datalink_icao())
        .where(F.col("icao").isNotNull() & F.col("_location.alt").isNotNull())
        .select(
            "seq",
            "received_at",
            "icao",
            datalink_time().alias("message_time"),
            F.col("_location.loc.lat").alias("latitude"),
            F.col("_location.loc.lon").alias("longitude"),
            F.col("_location.alt").alias("altitude_ft"),
        )
    )


def acars_reports(docs: DataFrame) -> DataFrame:
    """Weather carried in message text, one row per message that yields any."""
    acars = F.col("doc.vdl2.avlc.acars")
    fields = docs.select(
        "seq",
        "received_at",
        datalink_icao().alias("icao"),
        datalink_time().alias("message_time"),
        F.coalesce(acars["flight"], F.lit("")).alias("flight"),
        F.coalesce(acars["reg"], F.lit("")).alias("reg"),
        acars["msg_text"].alias("msg_text"),
    ).where(F.col("msg_text") != "")
    return (
        with_weather_text(fields)
        .where(F.col("weather").isNotNull())
        .select(
            "seq", "received_at", "icao", "message_time", "flight", "reg", "format", "weather.*"
        )
    )
