"""SQL counterparts of the registered queries, written for DuckDB.

Each statement is written from the description of the operator over the same
tables; it shares no code with the Spark side.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

NOW = "TIMESTAMP '2024-01-30 12:34:56'"
START = "TIMESTAMP '2024-01-05 00:10:00'"
END = "TIMESTAMP '2024-01-25 12:50:00'"

# --- tables derived from `events` --------------------------------------------------
_ALT = "CASE WHEN event_id % 29 <> 0 THEN ((event_id * 7919 % 13500) - 100)::DOUBLE END"
_TEMP = (
    f"CASE WHEN event_id % 97 = 0 THEN -150e0 ELSE 15e0 - 6.5e-3 * ({_ALT}) "
    "+ (value - 50e0) / 10e0 END"
)
_ICAO = "lpad((user_id % 25)::VARCHAR, 8, '0')"

OBS = f"""
raw_obs AS (
  SELECT event_id AS obs_id, ts AS time,
    CASE WHEN event_id % 17 <> 0 THEN 'FL' || (user_id % 100)::VARCHAR END AS callsign,
    {_ICAO} AS icao,
    (event_id * 31 % 120)::DOUBLE AS distance,
    {_ALT} AS altitude,
    35e0 + (event_id * 13 % 1000) / 1000e0 AS latitude,
    139e0 + (event_id * 17 % 1000) / 1000e0 AS longitude,
    {_TEMP} AS temperature,
    ((event_id * 11 % 81) - 40)::DOUBLE AS wind_x,
    ((event_id * 23 % 81) - 40)::DOUBLE AS wind_y,
    CASE WHEN event_type IN ('error', 'signup') THEN 'vdl2' ELSE 'mode-s' END AS method
  FROM events),
obs AS (
  SELECT *, (270e0 - degrees(atan2(wind_y, wind_x))) % 360e0 AS wind_angle,
    sqrt(wind_x * wind_x + wind_y * wind_y) AS wind_speed
  FROM raw_obs)"""

FIT = """
fit AS (
  SELECT * FROM obs WHERE distance <= 100 AND altitude IS NOT NULL
    AND altitude BETWEEN 0 AND 13000 AND temperature > -100)"""

POS = """
pos AS (
  SELECT obs_id AS seq, time, CASE WHEN obs_id % 2 = 0 THEN 'ab' || icao ELSE ' AB' || icao || ' ' END AS icao,
    CASE WHEN obs_id % 3 = 0 THEN lower(callsign) ELSE callsign || ' ' END AS callsign,
    altitude AS altitude_m, latitude, longitude
  FROM obs WHERE method = 'mode-s' AND altitude > 0)"""

PROBES = "probes AS (SELECT obs_id AS seq, time, 'aB' || icao AS icao FROM obs WHERE method = 'vdl2')"


def _bucket(seconds: int) -> str:
    # local wall clock is nine hours ahead; cut there, then move back
    return (
        f"(time_bucket(INTERVAL '{seconds} seconds', time + INTERVAL 9 HOUR, "
        "TIMESTAMP '2000-01-01') - INTERVAL 9 HOUR)"
    )


def _grid(name: str, seconds: int) -> str:
    return f"""
{name} AS (
  SELECT DISTINCT ON (time_bucket, altitude_bin)
    {_bucket(seconds)} AS time_bucket, (floor(altitude / 250) * 250)::INTEGER AS altitude_bin,
    time, altitude, temperature, wind_x, wind_y, wind_speed, wind_angle
  FROM fit ORDER BY time_bucket, altitude_bin, time DESC, obs_id DESC)"""


HALF = _grid("half_hour", 1800)
THREE = _grid("three_hour", 10800)

_FEET = f"greatest(coalesce(floor(({_ALT}) / 0.3048e0)::BIGINT, 0), 0)"
_CELSIUS = f"coalesce(floor({_TEMP})::BIGINT, (event_id % 60) - 50)"
LINES = f"""
parts AS (
  SELECT event_id AS e, event_id AS seq, ts AS received_at, user_id,
    {_CELSIUS} AS celsius, {_FEET} AS feet,
    lpad((event_id * 7 % 360)::VARCHAR, 3, '0') AS direction,
    (event_id * 3 % 140 + 10) AS knots_n,
    lpad((event_id * 37 % 1000000)::VARCHAR, 6, '0') AS clock, epoch_us(ts) AS us,
    {_ICAO} AS icao8
  FROM events WHERE event_type IN ('error', 'signup')),
worded AS (
  SELECT *, lpad((abs(celsius) % 100)::VARCHAR, 2, '0') AS deg,
    left(CASE WHEN length(knots_n::VARCHAR) < 2 THEN '0' || knots_n ELSE knots_n::VARCHAR END, 2) AS knots,
    CASE WHEN celsius < 0 THEN 'M' ELSE 'P' END AS sign_m,
    CASE WHEN celsius < 0 THEN '-' ELSE 'P' END AS sign_d FROM parts),
texts AS (
  SELECT *, CASE e % 3
    WHEN 0 THEN 'POS REPORT\\r\\nWN35' || lpad((e * 13 % 640)::VARCHAR, 3, '0') || 'E139'
      || CASE WHEN e % 2 = 0 THEN lpad((e * 17 % 60)::VARCHAR, 2, '0')
              ELSE lpad((e * 17 % 600)::VARCHAR, 3, '0') END
      || clock || CASE WHEN e % 7 = 0 THEN 'P' ELSE '' END || lpad(feet::VARCHAR, 5, '0')
      || sign_d || deg || direction || CASE WHEN e % 11 = 0 THEN ' ' ELSE '' END || knots
      || CASE WHEN e % 11 = 0 THEN ' 99' ELSE '005200' END || '\\r\\nEND'
    WHEN 1 THEN 'PNTAF ' || CASE WHEN e % 13 = 0 THEN 'S' ELSE 'N' END || '35'
      || lpad((e * 13 % 1000)::VARCHAR, 3, '0') || 'E139' || lpad((e * 17 % 1000)::VARCHAR, 3, '0')
      || clock || lpad((feet // 100)::VARCHAR, 3, '0') || sign_m || deg || direction
      || CASE WHEN (e // 3) % 2 = 0 THEN knots || '086' ELSE ' ' || knots || ' 106' END
    ELSE 'REQ FL' || lpad((feet // 100)::VARCHAR, 3, '0') || CASE e % 4
      WHEN 0 THEN ' ' || sign_m || deg WHEN 1 THEN '/' || sign_m || deg ELSE '' END
    END AS txt FROM worded),
lines AS (
  SELECT seq, received_at, CASE
    WHEN e % 41 = 0 THEN '{{"vdl2":{{"t":' WHEN e % 43 = 0 THEN '[1,2,3]'
    ELSE '{{"vdl2":{{"t":{{"sec":' || (us // 1000000) || ',"usec":' || (us % 1000000)
      || '}},"avlc":{{"src":{{"addr":"' || CASE WHEN e % 19 = 0 THEN '' ELSE 'Ab' || icao8 END
      || '","type":"Aircraft"}},' || CASE WHEN e % 5 = 0 THEN
        '"xid":{{"vdl_params":[{{"name":"hop","value":1}},{{"name":"ac_location","value":{{"loc":{{"lat":35.'
        || lpad((e * 13 % 1000)::VARCHAR, 3, '0') || ',"lon":139.' || lpad((e * 17 % 1000)::VARCHAR, 3, '0')
        || '}}' || CASE WHEN e % 3 <> 2 THEN ',"alt":' || feet ELSE '' END || '}}}}]}}}}}}}}'
      ELSE '"acars":{{"flight":"FL' || (user_id % 100) || '","reg":"JA' || (user_id % 1000)
        || '","msg_text":"' || txt || '"}}}}}}}}' END END AS line FROM texts),
json_docs AS (SELECT seq, received_at, TRY_CAST(line AS JSON) AS j FROM lines),
docs AS (
  SELECT seq, received_at, j, nullif((j ->> '$.vdl2.avlc.src.addr'), '') AS icao,
    make_timestamp((j ->> '$.vdl2.t.sec')::BIGINT * 1000000
      + coalesce((j ->> '$.vdl2.t.usec')::BIGINT, 0)) AS message_time
  FROM json_docs WHERE json_type(j) = 'OBJECT' AND (j -> '$.vdl2') IS NOT NULL)"""

# --- Fixed values: the message patterns, whole ---------------------------------------
_WN1 = r"WN(\d{5})([EW])(\d{5,6})\d{6}P?(\d{5})([MP-])(\d{2})(\d{3})(\d{2,3})"
_WN2 = r"WN(\d{5})([EW])(\d{5,6})\d{6}P?(\d{5})([MP-])(\d{2})(\d{3})\s+(\d{2,3})"
_PN1 = r"([NS])(\d{5})([EW])(\d{6})(\d{6})(\d{3})([MP-])(\d{2})(\d{3})\s+(\d{2})"
_PN2 = r"([NS])(\d{5})([EW])(\d{6})(\d{6})(\d{3})([MP])(\d{2})(\d{3})(\d{2,3})"


def _groups(text: str, first: str, second: str, prefix: str, n: int) -> str:
    """All groups as a struct with fields prefix1, prefix2, ...; all groups have names, as
    only nine can be asked for by number."""
    names = "[" + ", ".join(f"'{prefix}{i}'" for i in range(1, n + 1)) + "]"
    return (
        f"CASE WHEN regexp_matches({text}, '{first}') THEN regexp_extract({text}, '{first}', {names}) "
        f"WHEN regexp_matches({text}, '{second}') THEN regexp_extract({text}, '{second}', {names}) END"
    )


_FLT = r"FL\d{3}\s*[/\s]?\s*([MP-])(\d{2})"


def _signed(sign: str, digits: str) -> str:
    return f"CASE WHEN {sign} IN ('M', '-') THEN -({digits}::INTEGER) ELSE {digits}::INTEGER END"


REPORTS = LINES + f""",
msgs AS (
  SELECT seq, received_at, icao, message_time, j ->> '$.vdl2.avlc.acars.flight' AS flight,
    j ->> '$.vdl2.avlc.acars.reg' AS reg, j ->> '$.vdl2.avlc.acars.msg_text' AS txt
  FROM docs WHERE coalesce((j ->> '$.vdl2.avlc.acars.msg_text'), '') <> ''),
wn_lines AS (
  SELECT *, list_filter(string_split(txt, chr(13) || chr(10)), lambda x: contains(x, 'WN'))[1] AS wn_line
  FROM msgs),
caught AS (
  SELECT *, {_groups('wn_line', _WN1, _WN2, 'w', 8)} AS wn, {_groups('txt', _PN1, _PN2, 'p', 10)} AS pn,
    regexp_matches(txt, '{_PN1}') AS spaced,
    regexp_extract(txt, 'FL(\\d{{3}})', 1) AS fl, regexp_extract(txt, '{_FLT}', 1) AS fs,
    regexp_extract(txt, '{_FLT}', 2) AS ft FROM wn_lines),
minutes AS (
  SELECT *, substr(w1, 3, 3)::INTEGER / 10e0 AS lat_min,
    CASE WHEN length(w3) = 5 THEN substr(w3, 4)::DOUBLE ELSE substr(w3, 4)::DOUBLE / 10e0 END AS lon_min
  FROM (SELECT *, {", ".join(f"wn.w{i} AS w{i}" for i in range(1, 9))},
    {", ".join(f"pn.p{i} AS p{i}" for i in range(1, 11))} FROM caught)),
kinds AS (
  SELECT *, CASE WHEN w1 IS NOT NULL AND lat_min < 60 AND lon_min < 60 THEN 'wn'
    WHEN p1 IS NOT NULL THEN 'pntaf' WHEN fl <> '' AND fl <> '000' THEN 'fl' END AS format FROM minutes),
reports AS (
  SELECT seq, received_at, icao, message_time, flight, reg, format,
    CASE format WHEN 'wn' THEN substr(w1, 1, 2)::INTEGER + lat_min / 60e0
      WHEN 'pntaf' THEN CASE p1 WHEN 'S' THEN -1 ELSE 1 END
        * (substr(p2, 1, 2)::INTEGER + substr(p2, 3)::INTEGER / 1000e0) END AS latitude,
    CASE format WHEN 'wn' THEN CASE w2 WHEN 'W' THEN -1 ELSE 1 END
        * (substr(w3, 1, 3)::INTEGER + lon_min / 60e0)
      WHEN 'pntaf' THEN CASE p3 WHEN 'W' THEN -1 ELSE 1 END
        * (substr(p4, 1, 3)::INTEGER + substr(p4, 4)::INTEGER / 1000e0) END AS longitude,
    CASE format WHEN 'wn' THEN w4::INTEGER
      WHEN 'pntaf' THEN CASE WHEN NOT spaced AND p6::INTEGER BETWEEN 100 AND 500 THEN p6::INTEGER * 100 END
      WHEN 'fl' THEN fl::INTEGER * 100 END AS altitude_ft,
    CASE format WHEN 'wn' THEN {_signed('w5', 'w6')} WHEN 'pntaf' THEN {_signed('p7', 'p8')}
      WHEN 'fl' THEN CASE WHEN ft <> '' THEN {_signed('fs', 'ft')} END END AS temperature_c,
    CASE format WHEN 'wn' THEN w7::INTEGER WHEN 'pntaf' THEN p9::INTEGER END AS wind_dir_deg,
    CASE format WHEN 'wn' THEN w8::INTEGER WHEN 'pntaf' THEN p10::INTEGER END AS wind_speed_kt
  FROM kinds WHERE format IS NOT NULL),
xid AS (
  SELECT seq, received_at, icao, (v ->> '$.loc.lat')::DOUBLE AS latitude,
    (v ->> '$.loc.lon')::DOUBLE AS longitude, (v ->> '$.alt')::INTEGER AS altitude_ft
  FROM (SELECT *, (list_filter(from_json(j -> '$.vdl2.avlc.xid.vdl_params', '["JSON"]'),
          lambda p: (p ->> '$.name') = 'ac_location')[1] -> '$.value') AS v FROM docs)
  WHERE icao IS NOT NULL AND (v ->> '$.alt') IS NOT NULL)"""

MSG = f"""
msg AS (
  SELECT event_id AS seq, ts AS time, {_ICAO} AS icao, event_id % 5 AS k,
    CASE WHEN event_id % 5 >= 3 AND event_id % 7 = 6 THEN '17' WHEN event_id % 5 = 2 THEN '44'
      WHEN event_id % 5 = 3 THEN '50' WHEN event_id % 5 = 4 THEN '60' END AS bds,
    CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 17 ELSE 18 END
      WHEN event_id % 5 = 1 THEN 17 WHEN event_id % 2 = 0 THEN 20 ELSE 21 END AS df,
    CASE event_id % 5 WHEN 0 THEN 9 + event_id % 15 WHEN 1 THEN 1 + event_id % 4 END AS typecode,
    'FL' || (user_id % 100)::VARCHAR AS name, floor(({_ALT}) / 0.3048e0) AS alt_ft,
    event_id % 47 <> 0 AS located, 35e0 + (event_id * 13 % 1000) / 1000e0 AS la,
    139e0 + (event_id * 17 % 1000) / 1000e0 AS lo,
    CASE WHEN event_id % 37 <> 0 THEN {_TEMP} END AS t44, (event_id * 3 % 120)::DOUBLE AS s44,
    (event_id * 29 % 360)::DOUBLE AS d44, (event_id * 7 % 360)::DOUBLE AS trk,
    CASE WHEN event_id % 31 <> 0 THEN (event_id * 11 % 150 + 350)::DOUBLE END AS gs,
    (event_id * 13 % 120 + 380)::DOUBLE AS tas, (event_id * 5 % 360)::DOUBLE AS hdg,
    CASE WHEN event_id % 23 = 4 THEN 0e0 ELSE (event_id * 17 % 30 + 60) / 100e0 END AS mach
  FROM events),
used AS (
  SELECT seq, time, icao, k, bds,
    CASE WHEN typecode BETWEEN 1 AND 4 AND k = 1 THEN name END AS callsign,
    CASE WHEN k = 0 AND (typecode BETWEEN 5 AND 18 OR typecode BETWEEN 20 AND 22) AND alt_ft > 0
      THEN alt_ft END AS altitude_ft,
    CASE WHEN k = 0 AND (typecode BETWEEN 5 AND 18 OR typecode BETWEEN 20 AND 22) AND alt_ft > 0
      AND located THEN la END AS lat,
    CASE WHEN k = 0 AND (typecode BETWEEN 5 AND 18 OR typecode BETWEEN 20 AND 22) AND alt_ft > 0
      AND located THEN lo END AS lon,
    CASE WHEN bds = '44' AND t44 IS NOT NULL THEN t44 END AS t44, s44, d44,
    CASE WHEN bds = '50' AND gs IS NOT NULL THEN seq END AS at50,
    CASE WHEN bds = '60' THEN seq END AS at60, trk, gs, tas, hdg, mach FROM msg),
state AS (
  SELECT *, last_value(callsign IGNORE NULLS) OVER w AS last_callsign,
    last_value(altitude_ft IGNORE NULLS) OVER w AS last_altitude_ft,
    last_value(lat IGNORE NULLS) OVER w AS last_lat, last_value(lon IGNORE NULLS) OVER w AS last_lon,
    last_value(at50 IGNORE NULLS) OVER w AS last50, last_value(at60 IGNORE NULLS) OVER w AS last60,
    last_value(CASE WHEN at60 IS NOT NULL THEN mach END IGNORE NULLS) OVER w AS last_mach
  FROM used WINDOW w AS (PARTITION BY icao ORDER BY seq ROWS UNBOUNDED PRECEDING))"""

# --- formulas ------------------------------------------------------------------------------
_RLAT, _RLON = "35.682677e0", "139.762230e0"


def _hav(lat: str, lon: str) -> str:
    a = (
        f"(pow(sin(radians({lat} - {_RLAT}) / 2), 2) + cos(radians({_RLAT})) * cos(radians({lat})) "
        f"* pow(sin(radians({lon} - {_RLON}) / 2), 2))"
    )
    return f"(12742e0 * atan2(sqrt({a}), sqrt(1e0 - {a})))"


def _flat(lat: str, lon: str) -> str:
    return (
        f"sqrt(pow(({lat} - {_RLAT}) * 111e0, 2) "
        f"+ pow(({lon} - {_RLON}) * 111e0 * cos(radians({_RLAT})), 2))"
    )


def _decl(lat: str, lon: str) -> str:
    u, v = f"({lat} - 37e0)", f"({lon} - 138e0)"
    return (
        f"((8e0 + 15.822e0 / 60) + 18.462e0 / 60 * {u} - 7.726e0 / 60 * {v} "
        f"+ 0.007e0 / 60 * {u} * {u} + 0.007e0 / 60 * {u} * {v} - 0.655e0 / 60 * {v} * {v})"
    )


def _temp(air: str, mach: str) -> str:
    return (
        f"CASE WHEN {mach} > 0 THEN pow({air} / {mach}, 2) * (28.966e-3 / 1.403e0 / 8.314472e0) "
        "- 273.15e0 END"
    )


def _wind(lat, lon, trk, gs, hdg, air) -> tuple[str, str]:
    g, h = f"radians({trk})", f"radians({hdg} - {_decl(lat, lon)})"
    return f"({gs} * sin({g}) - {air} * sin({h}))", f"({gs} * cos({g}) - {air} * cos({h}))"


def _circ(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), 360e0 - abs({a} - {b}))"


def put(name: str, ctes: list[str], source: str, columns: str, doubles: str = "", places: int = 6) -> None:
    """Register a statement; `doubles` are rounded to `places` and never negative zero."""
    rounded = []
    for item in [d.strip() for d in doubles.split("|") if d.strip()]:
        expr, _, alias = item.rpartition(" AS ")
        expr, alias = (expr, alias) if expr else (alias, alias)
        rounded.append(f"round({expr}, {places}) + 0e0 AS {alias}")
    picked = ", ".join([c for c in [columns.strip()] if c] + rounded)
    head = "WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else ""
    ORACLES[name] = f"{head}SELECT {picked} FROM {source}"


# --- sources -------------------------------------------------------------------------------
_HEX = "lpad(upper(to_hex(event_id)), {0}, '8')"
_HEX_LINES = f"""l AS (SELECT event_id AS seq, CASE event_id % 6
    WHEN 0 THEN {_HEX.format(28)} WHEN 1 THEN '*' || {_HEX.format(22)} || ';'
    WHEN 2 THEN '*' || {_HEX.format(28)} || ';' WHEN 3 THEN '*' || {_HEX.format(14)} || ';'
    WHEN 4 THEN '  *' || {_HEX.format(28)} || '; ' ELSE '' END AS line FROM events),
  c AS (SELECT seq, rtrim(substr(trim(line), 2), ';') AS hex FROM l WHERE trim(line) LIKE '*%')"""
put("s1_modes_line_scan", [_HEX_LINES],
    "c WHERE length(hex) >= 22", "seq, hex")
put("s1_numbered_capture", [_HEX_LINES, LINES, """
n AS (SELECT row_number() OVER (ORDER BY seq) AS seq, hex AS text FROM c WHERE length(hex) >= 22
  UNION ALL SELECT (SELECT count(*) FROM c WHERE length(hex) >= 22) + row_number() OVER (ORDER BY seq), line FROM lines)"""],
    "n", "seq, text")
put("s2_datalink_json_scan", [LINES], "docs",
    "seq, j ->> '$.vdl2.avlc.src.type' AS sender_type, "
    "(j -> '$.vdl2.avlc.acars') IS NOT NULL AS has_acars, (j -> '$.vdl2.avlc.xid') IS NOT NULL AS has_xid")
put("s3_observation_scan", [OBS], "obs WHERE distance <= 50", "time", "altitude | temperature")
put("s4_append_observations", [OBS], "obs",
    "obs_id, time, coalesce(callsign, icao, '') AS callsign, method, strftime(time, '%Y-%m-%d') AS day",
    "coalesce(temperature, 0) AS temperature | wind_x")
put("s5_comparison_csv", [OBS], "obs",
    """strftime(time, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
    CASE method WHEN 'mode-s' THEN 'modes' ELSE 'vdl2' END AS source, coalesce(callsign, '') AS callsign,
    coalesce(printf('%.1f', altitude), '') AS altitude_m, coalesce(printf('%.1f', temperature), '') AS temperature_c,
    printf('%.1f', wind_speed) AS wind_speed_ms, printf('%.1f', wind_angle) AS wind_direction_deg,
    printf('%.4f', latitude) AS latitude, printf('%.4f', longitude) AS longitude""")
put("s8_naive_time_migration", [OBS], "obs", "obs_id, time - INTERVAL 9 HOUR AS time")

_PAIRS = f"""
pairs AS (
  SELECT a.obs_id AS modes_obs_id, b.obs_id AS vdl2_obs_id, a.time AS modes_time, b.time AS vdl2_time,
    (epoch_us(b.time) - epoch_us(a.time)) / 1e6 AS time_diff_s,
    abs(b.altitude - a.altitude) AS altitude_diff_m, abs(b.temperature - a.temperature) AS temp_diff_c,
    abs(b.wind_speed - a.wind_speed) AS wind_speed_diff_ms,
    {_circ('b.wind_angle', 'a.wind_angle')} AS wind_dir_diff_deg
  FROM obs a JOIN obs b ON a.method = 'mode-s' AND b.method = 'vdl2'
    AND b.time > a.time AND b.time <= a.time + INTERVAL 3600 SECOND
    AND abs(b.altitude - a.altitude) <= 500),
bad AS (SELECT * FROM pairs WHERE temp_diff_c > 10 OR wind_speed_diff_ms > 10 OR wind_dir_diff_deg > 45)"""
put("s6_discrepancy_json", [OBS, _PAIRS], "bad",
    "modes_time AS modes_timestamp, vdl2_time AS vdl2_timestamp",
    "time_diff_s AS time_s | wind_dir_diff_deg AS wind_dir_deg")
_KIND = """CASE WHEN df IN (17, 18) AND typecode BETWEEN 1 AND 4 THEN 'callsign'
    WHEN df IN (17, 18) AND (typecode BETWEEN 5 AND 18 OR typecode BETWEEN 20 AND 22) THEN 'position'
    WHEN df IN (20, 21) THEN CASE bds WHEN '44' THEN 'bds44' WHEN '50' THEN 'bds50'
      WHEN '60' THEN 'bds60' ELSE 'comm_b' END END"""
put("s7_numbered_arrivals", [LINES], "lines", "row_number() OVER (ORDER BY seq // 500 % 3, seq) AS seq, line")
put("s7_landing_stream", [MSG], "msg", f"seq, icao, {_KIND} AS kind")

# --- filters ----------------------------------------------------------------------------------
_IN = f"time >= {START} AND time <= {END}"
put("p1_allowed_columns", [OBS], "obs", "time, method", "wind_x")
put("p2_quality_filter", [OBS, FIT], f"fit WHERE {_IN}", "obs_id, time", "altitude | temperature")
put("p2_quality_filter_limited", [OBS, FIT],
    f"fit WHERE {_IN} AND distance <= 80 AND altitude <= 2000", "obs_id")
put("p3_grid_range_filter", [OBS, FIT, HALF],
    f"half_hour WHERE time_bucket >= {START} AND time_bucket <= {END} AND altitude <= 2000",
    "time_bucket, altitude_bin", "temperature")
put("p4_valid_observation", [OBS], "obs WHERE altitude > 0", "obs_id")
put("p5_finite_rows", [OBS], "obs WHERE temperature > -100 AND altitude BETWEEN 0 AND 13000",
    "obs_id", "altitude | temperature")
put("p6_absurd_temperature_drop", [OBS], "obs WHERE temperature >= -100", "obs_id")
_WINDY = "sqrt(wind_x * wind_x + wind_y * wind_y) > 0.1e0"
put("p7_calm_wind_filter", [OBS], f"obs WHERE {_WINDY}", "obs_id")
put("p7_calm_wind_filter_limited", [OBS], f"obs WHERE {_WINDY} AND altitude <= 2000", "obs_id")
put("p8_altitude_bands", [OBS, "bands AS (SELECT * FROM (VALUES (1500), (3000), (4500), (6000)) b(band))"],
    "obs JOIN bands ON altitude BETWEEN band - 100 AND band + 100", "obs_id, band")
put("p8_altitude_bands_limited", [OBS, "bands AS (SELECT * FROM (VALUES (500), (1000), (1500)) b(band))"],
    "obs JOIN bands ON altitude BETWEEN band - 100 AND band + 100", "obs_id, band")
put("p9_tail_window", [OBS], "obs WHERE time >= (SELECT max(time) - INTERVAL 3 HOUR FROM obs)", "obs_id, time")
put("p10_extended_range", [OBS, FIT],
    f"""fit WHERE epoch_us(time) >= epoch_us({START}) - (epoch_us({END}) - epoch_us({START})) // 10
    AND epoch_us(time) <= epoch_us({END}) + (epoch_us({END}) - epoch_us({START})) // 10""", "obs_id")
put("p11_clock_columns", [OBS], "obs", "obs_id, time + INTERVAL 9 HOUR AS local_time",
    "(epoch_us(time) + 32400000000) / 86400e6 AS day_number")
put("p12_period_clamp", [OBS, """
d AS (SELECT min(time) AS lo, max(time) AS hi FROM obs),
r AS (SELECT obs_id, days, date_trunc('minute', time - to_days(days::INTEGER)) AS s,
    date_trunc('minute', time + INTERVAL 2 DAY) AS e, lo, hi
  FROM obs, d, (VALUES (1), (7), (30), (180), (365)) p(days)),
c AS (SELECT *, s < lo AS early, e > hi AS late, CASE WHEN s < lo THEN date_trunc('minute', lo) ELSE s END AS s1,
    CASE WHEN e > hi THEN date_trunc('minute', hi) ELSE e END AS e1 FROM r),
b AS (SELECT *, e1 - to_days(days::INTEGER) AS back FROM c),
f AS (SELECT *, CASE WHEN back >= lo THEN date_trunc('minute', back) ELSE s1 END AS s2 FROM b)"""],
    "f", "obs_id, days, s2 AS clamped_start, e1 AS clamped_end, (early OR late OR s2 <> s1) AS adjusted, s2 <= e1 AS valid")
put("p13_storage_form", [OBS], "obs", "obs_id, coalesce(callsign, icao, '') AS callsign",
    "coalesce(temperature, 0) AS temperature | CASE WHEN wind_x > 0 THEN wind_x ELSE 0 END AS wind_x | latitude")
put("p14_message_routing", [MSG], "msg", f"seq, {_KIND} AS kind")
put("p15_detail_level", [], "events",
    "event_id, CASE WHEN value <= 14 THEN 'raw' WHEN value <= 90 THEN 'half_hour' ELSE 'three_hour' END AS level",
    "value AS days")
put("p16_grid_fallback_empty", [OBS, FIT], f"fit WHERE {_IN}", "time", "altitude | temperature")
put("p16_grid_fallback_filled", [OBS, FIT, THREE],
    f"three_hour WHERE time_bucket >= {START} AND time_bucket <= {END}",
    "time_bucket AS time", "altitude | temperature")
put("p17_minimum_sample", [OBS,
    "g AS (SELECT (floor(altitude / 250) * 250)::INTEGER AS altitude_bin, method, count(*) AS n FROM obs GROUP BY ALL)"],
    "g", "altitude_bin, method, n, n >= 10 AS enough")

# --- scalar functions ------------------------------------------------------------------------------
put("f1_unit_conversion", [], "events", "event_id", "value * 0.3048e0 AS metres | value * 0.514444e0 AS ms")
put("f2_haversine_distance", [OBS], "obs", "obs_id", f"{_hav('latitude', 'longitude')} AS km")
put("f3_flat_distance", [OBS], "obs", "obs_id", f"{_flat('latitude', 'longitude')} AS km")
put("f4_magnetic_declination", [OBS], "obs", "obs_id", f"{_decl('latitude', 'longitude')} AS declination")
put("f5_air_temperature", [], "events", "event_id",
    f"{_temp('(event_id * 13 % 120 + 150)::DOUBLE', '((event_id % 10)::DOUBLE / 10e0)')} AS temperature")
_X, _Y = _wind("latitude", "longitude", "(obs_id * 7 % 360)", "(obs_id * 11 % 150 + 150)::DOUBLE",
               "(obs_id * 5 % 360)::DOUBLE", "(obs_id * 13 % 120 + 160)::DOUBLE")
put("f6_wind_triangle", [OBS, f"w AS (SELECT obs_id, {_X} AS x, {_Y} AS y FROM obs)"], "w", "obs_id",
    "x | y | (270e0 - degrees(atan2(y, x))) % 360e0 AS angle | sqrt(x * x + y * y) AS speed")
put("f7_wind_from_polar", [], "events", "event_id",
    "-value * sin(radians(event_id * 29 % 360)) AS x | -value * cos(radians(event_id * 29 % 360)) AS y")
put("f8_circular_difference", [], "events", "event_id",
    f"{_circ('(event_id * 29 % 360)', '(event_id * 7 % 360)')}::DOUBLE AS difference")
_P = "seq, altitude_ft, temperature_c, wind_dir_deg, wind_speed_kt"
put("f9_wn_parser", [REPORTS], "reports WHERE format = 'wn'", _P, "latitude | longitude")
put("f10_pntaf_parser", [REPORTS], "reports WHERE format = 'pntaf'", _P, "latitude | longitude")
put("f11_flight_level_parser", [REPORTS], "reports WHERE format = 'fl'", "seq, altitude_ft, temperature_c")
put("f12_acars_format_priority", [REPORTS], "reports", "seq, flight, reg, format, altitude_ft")
put("f13_sender_address", [LINES], "docs", "seq, icao")
put("f14_xid_location", [REPORTS], "xid", "seq, icao, altitude_ft", "latitude | longitude")
put("f15_message_time", [LINES], "docs", "seq, message_time")
put("f16_identifiers", [], "events",
    "event_id, 'FL' || user_id || '__' AS identifier, 'fl' || user_id AS callsign")
put("f17_half_hour_bucket", [OBS], "obs", f"obs_id, {_bucket(1800)} AS bucket")
put("f18_three_hour_bucket", [OBS], "obs", f"obs_id, {_bucket(10800)} AS bucket")
put("f19_align_to_bucket", [OBS], "obs",
    f"obs_id, {_bucket(1800)} AS half_hour, {_bucket(10800)} AS three_hour")
put("f20_altitude_bin", [OBS], "obs", "obs_id, (floor(altitude / 250) * 250)::INTEGER AS altitude_bin",
    "(floor(altitude / 250) + 0.5e0) * 250 AS bin_centre")
put("f21_altitude_source_label", [], "events",
    "event_id, CASE WHEN abs(value / 10e0 - 2e0) < 1 THEN 'adsb' ELSE 'interpolated' END AS altitude_source")
_S22 = "CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN value * 0.514444e0 END"
put("f22_imperial_observation", [], "events", "event_id",
    f"""(event_id * 37 % 40000)::DOUBLE * 0.3048e0 AS altitude
    | -({_S22}) * sin(radians(event_id * 29 % 360)) AS wind_x
    | -({_S22}) * cos(radians(event_id * 29 % 360)) AS wind_y | {_S22} AS wind_speed""")
_RDIST = "CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN {0} ELSE 0e0 END AS distance"
put("f23_report_observations", [REPORTS], "reports WHERE altitude_ft IS NOT NULL AND temperature_c IS NOT NULL",
    "seq AS obs_id, received_at AS time, flight AS callsign",
    f"""{_RDIST.format(_flat('latitude', 'longitude'))} | altitude_ft * 0.3048e0 AS altitude
    | temperature_c::DOUBLE AS temperature
    | -wind_speed_kt * 0.514444e0 * sin(radians(wind_dir_deg)) AS wind_x
    | CASE WHEN wind_dir_deg IS NOT NULL THEN wind_speed_kt * 0.514444e0 END AS wind_speed""")
put("f24_weather_records", [REPORTS],
    """reports WHERE altitude_ft IS NOT NULL AND (temperature_c IS NOT NULL
    OR (wind_dir_deg IS NOT NULL AND wind_speed_kt IS NOT NULL))""",
    "seq, coalesce(icao, '') AS icao, nullif(flight, '') AS callsign",
    """altitude_ft::DOUBLE AS altitude_ft | latitude | longitude | temperature_c::DOUBLE AS temperature_c
    | wind_speed_kt::DOUBLE AS wind_speed_kt | wind_dir_deg::DOUBLE AS wind_direction_deg""")
_TOWARD = "((90e0 - degrees(atan2({1}, {0}))) % 360e0 + 360e0) % 360e0"
put("f25_toward_angle", [OBS], "obs", "obs_id", f"{_TOWARD.format('wind_x', 'wind_y')} AS toward_angle")
put("f26_age_seconds", [OBS], "obs", "obs_id",
    f"greatest(0, (epoch_us({NOW}) - epoch_us(time)) / 1e6) AS age")
put("f27_whole_feet", [OBS], "obs", "obs_id, trunc(altitude / 0.3048e0)::INTEGER AS feet")

# --- joins ---------------------------------------------------------------------------------------
_NEAR = """
near AS (
  SELECT DISTINCT ON (p.{k}) p.{k} AS probe, q.seq AS position_seq, q.altitude_m, q.latitude, q.longitude,
    epoch_us(q.time) - epoch_us(p.{t}) AS off
  FROM {probes} p JOIN pos q ON upper(trim(p.icao)) = upper(trim(q.icao)) AND abs(epoch_us(q.time) - epoch_us(p.{t})) <= 3600000000
  ORDER BY p.{k}, abs(off), off DESC, q.seq DESC)"""
put("j1_nearest_time_position", [OBS, POS, PROBES, _NEAR.format(k="seq", t="time", probes="probes")],
    "probes LEFT JOIN near ON seq = probe",
    """seq, position_seq, CASE WHEN abs(off) < 1000000 THEN 'adsb' WHEN off IS NOT NULL
    THEN 'interpolated' END AS match_source""", "altitude_m | off / 1e6 AS offset_s")
_ORDER = """
near AS (
  SELECT DISTINCT ON (p.seq) p.seq AS probe, q.seq AS position_seq, q.altitude_m, q.latitude, q.longitude,
    abs(q.seq - p.seq) AS index_distance
  FROM {probes} p JOIN pos q ON upper(trim(p.icao)) = upper(trim(q.icao)) AND {cond}
  ORDER BY p.seq, abs(q.seq - p.seq), q.seq DESC)"""
put("j2_nearest_order_position", [OBS, POS, PROBES,
    _ORDER.format(probes="probes", cond="abs(q.seq - p.seq) <= 1000")],
    "probes LEFT JOIN near ON seq = probe", "seq, position_seq, index_distance")
_BACK = "q.seq <= p.seq AND q.seq >= p.seq - 1000"
put("j2_backward_order_position", [OBS, POS, PROBES, _ORDER.format(probes="probes", cond=_BACK)],
    "probes LEFT JOIN near ON seq = probe", "seq, position_seq")
_IDS = """
known AS (SELECT DISTINCT upper(trim(icao)) AS known_icao FROM pos),
names AS (SELECT upper(trim(callsign)) AS name, arg_max(upper(trim(icao)), seq) AS mapped FROM pos
  WHERE trim(callsign) <> '' GROUP BY 1)"""
put("j3_identifier_resolution", [OBS, POS, _IDS,
    "n AS (SELECT obs_id, coalesce(callsign, 'aB' || icao) AS identifier FROM obs)"],
    "n LEFT JOIN known ON upper(trim(identifier)) = known_icao LEFT JOIN names ON upper(trim(identifier)) = name",
    "obs_id, identifier, coalesce(known_icao, mapped) AS resolved_icao")
_XID = """
latest AS (
  SELECT DISTINCT ON (a.seq) a.seq, x.seq AS xid_seq, x.altitude_ft AS xid_feet,
    x.latitude AS xid_lat, x.longitude AS xid_lon
  FROM {asking} a JOIN xid x ON x.icao = a.icao AND x.received_at <= a.received_at
    AND epoch_us(a.received_at) - epoch_us(x.received_at) <= 21600000000
  ORDER BY a.seq, x.received_at DESC),
taken AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY xid_seq ORDER BY seq) = 1)"""
_ASK = "asking AS (SELECT * FROM {0} WHERE icao IS NOT NULL AND altitude_ft IS NULL AND temperature_c IS NOT NULL{1})"
put("j4_xid_fill", [REPORTS, _ASK.format("reports", ""), _XID.format(asking="asking")],
    "taken", "seq, xid_seq, xid_feet")
_NAMED = """
named AS (
  SELECT r.*, coalesce(message_time, received_at) AS probe_time,
    coalesce(known_icao, mapped) AS found_icao
  FROM reports r LEFT JOIN known ON upper(trim(coalesce(icao, nullif(flight, '')))) = known_icao
  LEFT JOIN names ON upper(trim(coalesce(icao, nullif(flight, '')))) = name WHERE temperature_c IS NOT NULL),
lookup AS (SELECT * REPLACE (found_icao AS icao) FROM named)"""
_CASCADE = [OBS, REPORTS, POS, _IDS, _NAMED,
    _NEAR.format(k="seq", t="probe_time", probes="lookup"),
    "filled AS (SELECT n.*, altitude_m, near.latitude AS nlat, near.longitude AS nlon, off FROM named n LEFT JOIN near ON seq = probe)",
    _ASK.format("filled", " AND altitude_m IS NULL"), _XID.format(asking="asking"),
    """cascade AS (SELECT f.seq, CASE WHEN f.altitude_ft IS NOT NULL THEN 'acars' WHEN altitude_m IS NOT NULL
      THEN CASE WHEN abs(off) < 1000000 THEN 'adsb' ELSE 'interpolated' END WHEN xid_seq IS NOT NULL THEN 'xid' END AS altitude_source,
    coalesce(f.altitude_ft, trunc(altitude_m / 0.3048e0)::INTEGER, xid_feet) AS altitude_ft,
    CASE WHEN f.altitude_ft IS NOT NULL THEN f.latitude WHEN altitude_m IS NOT NULL THEN coalesce(f.latitude, nlat)
      ELSE coalesce(xid_lat, f.latitude) END AS latitude,
    CASE WHEN f.altitude_ft IS NOT NULL THEN f.longitude WHEN altitude_m IS NOT NULL THEN coalesce(f.longitude, nlon)
      ELSE coalesce(xid_lon, f.longitude) END AS longitude FROM filled f LEFT JOIN taken t ON t.seq = f.seq)"""]
put("j5_altitude_cascade", _CASCADE, "cascade WHERE altitude_source IS NOT NULL", "seq, altitude_ft, altitude_source",
    "latitude | longitude")
put("j5_altitude_cascade_replay", [OBS, REPORTS, POS, _IDS, _NAMED,
    _ORDER.format(probes="lookup", cond=_BACK),
    """c AS (SELECT n.seq, coalesce(n.altitude_ft, 0) > 0 AS own, altitude_m,
      CASE WHEN coalesce(n.altitude_ft, 0) > 0 THEN n.altitude_ft ELSE trunc(altitude_m / 0.3048e0)::INTEGER END AS altitude_ft,
      CASE WHEN coalesce(n.altitude_ft, 0) > 0 THEN n.latitude ELSE coalesce(n.latitude, near.latitude) END AS latitude,
      CASE WHEN coalesce(n.altitude_ft, 0) > 0 THEN n.longitude ELSE coalesce(n.longitude, near.longitude) END AS longitude
    FROM named n LEFT JOIN near ON n.seq = probe)"""],
    "c WHERE altitude_ft > 0", "seq, altitude_ft, CASE WHEN own THEN 'acars' ELSE 'interpolated' END AS altitude_source",
    "latitude | longitude")

# registers replayed one by one per aircraft: what is held after each check decides the next pair
_PAIR = """
checks AS (
  SELECT *, row_number() OVER (PARTITION BY icao ORDER BY seq) AS n FROM state
  WHERE k >= 2 AND (bds IS NULL OR bds <> '44')),
held AS (
  SELECT icao, n, seq, at50 IS NOT NULL AS h50, at60 IS NOT NULL AS h60,
    at50 IS NOT NULL AND at60 IS NOT NULL AND last_lat IS NOT NULL AS pairs FROM checks WHERE n = 1
  UNION ALL
  SELECT c.icao, c.n, c.seq, (h.h50 AND NOT h.pairs) OR c.at50 IS NOT NULL,
    (h.h60 AND NOT h.pairs) OR c.at60 IS NOT NULL,
    ((h.h50 AND NOT h.pairs) OR c.at50 IS NOT NULL) AND ((h.h60 AND NOT h.pairs) OR c.at60 IS NOT NULL)
      AND c.last_lat IS NOT NULL
  FROM held h JOIN checks c ON c.icao = h.icao AND c.n = h.n + 1),
paired AS (
  SELECT c.seq, c.icao, c.last_callsign, c.last_altitude_ft, c.last_lat AS la, c.last_lon AS lo,
    a.trk, a.gs * 0.514444e0 AS gs, a.tas * 0.514444e0 AS air, b.hdg, b.mach
  FROM held h JOIN checks c ON c.icao = h.icao AND c.n = h.n
  JOIN used a ON a.seq = c.last50 JOIN used b ON b.seq = c.last60 WHERE h.pairs)"""
_PX, _PY = _wind("la", "lo", "trk", "gs", "hdg", "air")
put("j6_register_pairs", [MSG, _PAIR], f"paired WHERE {_temp('air', 'mach')} >= -100",
    "seq AS obs_id, icao, last_callsign AS callsign",
    f"last_altitude_ft * 0.3048e0 AS altitude | {_hav('la', 'lo')} AS distance | {_temp('air', 'mach')} AS temperature | {_PX} AS wind_x | {_PY} AS wind_y")
_D44 = f"""direct AS (SELECT *, coalesce(last_lat, {_RLAT}) AS dla, coalesce(last_lon, {_RLON}) AS dlo FROM state
  WHERE t44 IS NOT NULL AND last_altitude_ft IS NOT NULL)"""
put("j8_direct_reports", [MSG, _D44], "direct", "seq AS obs_id, icao, last_callsign AS callsign",
    f"""last_altitude_ft * 0.3048e0 AS altitude | {_hav('dla', 'dlo')} AS distance | t44 AS temperature
    | -s44 * 0.514444e0 * sin(radians(d44)) AS wind_x | -s44 * 0.514444e0 * cos(radians(d44)) AS wind_y""")
put("j9_cross_source_discrepancies", [OBS, _PAIRS], "bad", "modes_obs_id, vdl2_obs_id",
    "time_diff_s | altitude_diff_m | temp_diff_c | wind_speed_diff_ms | wind_dir_diff_deg")
# k nearest by altitude: the run of k rows chosen by counting the half-way points passed
_HIST = """
judged AS (SELECT * FROM obs WHERE altitude IS NOT NULL AND temperature >= -100),
hist AS (SELECT * FROM {rows} WHERE altitude IS NOT NULL AND temperature > -100),
ranked AS (SELECT *, row_number() OVER (ORDER BY altitude, obs_id) AS rank_no,
    altitude + lead(altitude, 200) OVER (ORDER BY altitude, obs_id) AS twice FROM hist),
runs AS (SELECT *, avg(temperature) OVER r AS mean_t, stddev_pop(temperature) OVER r AS std_t, count(*) OVER r AS kn
  FROM ranked WINDOW r AS (ORDER BY rank_no ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING)),
passed AS (SELECT max(rank_no) AS rank_no, twice FROM ranked WHERE twice IS NOT NULL GROUP BY twice),
placed AS (SELECT j.*, coalesce(p.rank_no, 0) + 1 AS run FROM judged j ASOF LEFT JOIN passed p ON 2 * j.altitude > p.twice),
near AS (SELECT p.*, mean_t, std_t, kn FROM placed p JOIN runs r ON r.rank_no = p.run)"""
put("j10_altitude_neighbours", [OBS, _HIST.format(rows="judged")], "near", "obs_id, kn AS neighbours", "mean_t AS mean_temperature", 9)

# --- aggregations ------------------------------------------------------------------------------------
put("a1_data_range", [OBS], "obs", "min(time) AS earliest, max(time) AS latest, count(*) AS count")
_METHODS = "m AS (SELECT * FROM (VALUES ('mode-s'), ('vdl2')) t(name))"
_LAST = "seen AS (SELECT name AS method, max(time) AS last_received FROM m LEFT JOIN obs ON method = name GROUP BY name)"
put("a2_last_received", [OBS, _METHODS, _LAST], "seen", "method, last_received")
_RECENT = f"time >= {NOW} - INTERVAL {{0}} HOUR"
put("a3_observation_counts", [OBS, _METHODS],
    f"m LEFT JOIN obs ON method = name AND {_RECENT.format(24)} GROUP BY name", "name AS method, count(obs_id) AS count")
_GSTAT = "SELECT '{0}' AS grid, count(*) AS row_count, min(time_bucket) AS earliest, max(time_bucket) AS latest, FALSE AS error FROM {0}"
put("a4_grid_statistics", [OBS, FIT, HALF, THREE,
    f"s AS ({_GSTAT.format('half_hour')} UNION ALL {_GSTAT.format('three_hour')})"], "s", "*")
_QUAL = f"""q AS (SELECT name AS method, count(*) FILTER ({_RECENT.format(1)}) AS last_hour,
    count(*) FILTER ({_RECENT.format(24)}) AS last_24h, max(time) AS last_received,
    greatest(0, (epoch_us({NOW}) - epoch_us(max(time))) / 1e6) AS age_seconds,
    (SELECT count(*) FROM half_hour) AS half_hour_rows, (SELECT count(*) FROM three_hour) AS three_hour_rows
  FROM m LEFT JOIN obs ON method = name GROUP BY name)"""
put("a5_receiver_quality", [OBS, FIT, HALF, THREE, _METHODS, _QUAL], "q",
    "method, last_hour, last_24h, last_received, half_hour_rows, three_hour_rows", "age_seconds")
put("a6_quality_metrics", [OBS, FIT, HALF, THREE, _METHODS, _QUAL, """l AS (
  SELECT 'observations_total' AS name, method AS label, last_24h::DOUBLE AS value FROM q
  UNION ALL SELECT 'observations_last_hour', method, last_hour FROM q
  UNION ALL SELECT 'last_observation_age_seconds', method, round_even(age_seconds, 0) FROM q WHERE age_seconds IS NOT NULL
  UNION ALL SELECT 'aggregate_rows', 'half_hour', count(*) FROM half_hour
  UNION ALL SELECT 'aggregate_rows', 'three_hour', count(*) FROM three_hour)"""], "l", "name, label", "value")
_GV = "altitude | temperature | wind_x | wind_y | wind_speed | wind_angle"
put("a7_half_hour_grid", [OBS, FIT, HALF], "half_hour", "time_bucket, altitude_bin, time", _GV)
put("a7_three_hour_grid", [OBS, FIT, THREE], "three_hour", "time_bucket, altitude_bin, time", _GV)
put("a8_incremental_refresh", [OBS, FIT, THREE], "three_hour", "time_bucket, altitude_bin, time", _GV)
put("a8_merged_refresh", [OBS, FIT, THREE], "three_hour", "time_bucket, altitude_bin, time", _GV)
put("a9_full_rebuild", [OBS, FIT, HALF], "half_hour", "time_bucket, altitude_bin, time", _GV)
_WF = """
windy AS (SELECT * FROM fit WHERE sqrt(wind_x * wind_x + wind_y * wind_y) > 0.1e0{low}),
ext AS (SELECT min(epoch_us(time)) AS t0, max(epoch_us(time)) - min(epoch_us(time)) AS span,
    CASE WHEN span <= 86400000000 THEN 48 WHEN span <= 259200000000 THEN 24
      ELSE trunc(span / 86400e6 * 4)::BIGINT END AS bins FROM windy),
binned AS (SELECT least(((epoch_us(time) - t0) * bins) // span, bins - 1)::INTEGER AS time_bin,
    greatest(0, least(floor(altitude / {step}), {last}))::INTEGER AS alt_bin, wind_x, wind_y,
    epoch_us(time) / 86400e6 AS day FROM windy, ext),
field AS (SELECT time_bin, alt_bin, alt_bin * {step} AS altitude_bin, avg(day) AS mean_day,
    avg(wind_x) AS wind_x, avg(wind_y) AS wind_y FROM binned GROUP BY time_bin, alt_bin)"""
_FIELD = f"mean_day | wind_x | wind_y | sqrt(wind_x * wind_x + wind_y * wind_y) AS wind_speed | {_TOWARD.format('wind_x', 'wind_y')} AS toward_angle"
put("a10_wind_field", [OBS, FIT, _WF.format(low="", step=200, last=63)], "field",
    "time_bin, alt_bin, altitude_bin", _FIELD)
put("a10_wind_field_limited", [OBS, FIT, _WF.format(low=" AND altitude <= 2000", step=100, last=19)], "field",
    "time_bin, alt_bin, altitude_bin", _FIELD)
_PROF = """prof AS (SELECT (floor(altitude / 250) * 250)::INTEGER AS altitude_bin, median(temperature) AS median_temperature,
    (floor(altitude / 250) + 0.5e0) * 250 AS altitude_centre FROM {0} GROUP BY ALL)"""
put("a11_temperature_profile", [OBS, FIT,
    "prof AS (SELECT floor(altitude / 250) AS b, median(temperature) AS median_temperature FROM fit GROUP BY b)"],
    "prof", "(b * 250)::INTEGER AS altitude_bin", "median_temperature | (b + 0.5e0) * 250 AS altitude_centre")
put("a12_standard_atmosphere", [OBS, FIT,
    "prof AS (SELECT floor(altitude / 250) AS b, median(temperature) AS m FROM fit GROUP BY b)",
    "ground AS (SELECT m + 6.5e0 * (b + 0.5e0) * 250 / 1000e0 AS surface FROM prof ORDER BY b LIMIT 1)"],
    "ground, range(50) r(p)", "p::INTEGER AS point",
    "p * (13000e0 / 49) AS altitude | surface - 6.5e0 * (p * (13000e0 / 49)) / 1000e0 AS temperature")
_HODO = f"""hodo AS (SELECT floor(altitude / 250) AS b, median(wind_x) AS x, median(wind_y) AS y FROM {{0}} WHERE {_WINDY} GROUP BY b)"""
put("a13_hodograph", [OBS, FIT, _HODO.format("fit")], "hodo", "(b * 250)::INTEGER AS altitude_bin",
    "x AS median_wind_x | y AS median_wind_y | (b + 0.5e0) * 250 AS altitude_centre")
_BANDS = "bands AS (SELECT * FROM (VALUES (1500), (3000), (4500), (6000)) b(band))"
_SERIES = """
pts AS (SELECT band, epoch_us({time}) AS t, temperature FROM {rows} JOIN bands ON altitude BETWEEN band - 100 AND band + 100),
anchors AS (
  SELECT band, min(t) AS a FROM pts GROUP BY band HAVING count(*) > 1
  UNION ALL
  SELECT band, (SELECT min(p.t) FROM pts p WHERE p.band = anchors.band AND p.t > anchors.a + 1799971200)
  FROM anchors WHERE a IS NOT NULL),
bins AS (SELECT s.band, s.a, avg(p.temperature) AS mean_temperature, count(*) AS n
  FROM anchors s JOIN pts p ON p.band = s.band AND p.t BETWEEN s.a AND s.a + 1799971200 GROUP BY s.band, s.a)"""
_SCOLS = "band, make_timestamp(a) AS bin_start, n, make_timestamp(a + 899985600) AS bin_centre"
put("a14_anchored_bins", [OBS, FIT, _BANDS, _SERIES.format(time="time", rows="fit")], "bins", _SCOLS, "mean_temperature", 9)
put("a15_temperature_regression", [OBS, _HIST.format(rows="obs")], "hist", "count(*) AS n",
    "regr_slope(temperature, altitude) AS slope | regr_intercept(temperature, altitude) AS intercept")
put("a16_neighbour_deviation", [OBS, _HIST.format(rows="judged")], "near", "obs_id",
    "mean_t AS mean_temperature | std_t AS std_temperature", 9)
put("a17_outlier_flags", [OBS, _HIST.format(rows="obs"),
    "line AS (SELECT regr_slope(temperature, altitude) AS s, regr_intercept(temperature, altitude) AS i FROM hist)",
    """v AS (SELECT *, abs(temperature - (s * altitude + i)) AS residual, abs(temperature - mean_t) AS dev FROM near, line)"""],
    "v", "obs_id, residual > 3.25 AND (dev > 20 OR (std_t > 0 AND dev / std_t > 4)) AS is_outlier", "residual")
# Each step judges the rows up to the 50th accepted one; 400 rows always hold so many.
_IN_ORDER = """
todo AS MATERIALIZED (SELECT obs_id, method, altitude AS a, temperature AS t, row_number() OVER (PARTITION BY method ORDER BY time, obs_id) AS rn
  FROM obs WHERE altitude IS NOT NULL AND temperature >= -100),
fold AS (
  SELECT method, 0::BIGINT AS done, []::STRUCT(a DOUBLE, t DOUBLE)[] AS hist, []::BIGINT[] AS bad FROM (SELECT DISTINCT method FROM todo)
  UNION ALL (
  WITH s AS (SELECT * FROM fold WHERE done < (SELECT count(*) FROM todo WHERE todo.method = fold.method)),
  h AS (SELECT method, x.a, x.t, i FROM (SELECT method, unnest(hist) AS x, unnest(range(len(hist))) AS i FROM s)),
  line AS (SELECT method, regr_slope(t, a) AS m, regr_intercept(t, a) AS c FROM h GROUP BY method),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY a, i) AS no,
      a + lead(a, 200) OVER (PARTITION BY method ORDER BY a, i) AS twice FROM h),
  runs AS (SELECT method, no, avg(t) OVER r AS mean_t, stddev_pop(t) OVER r AS std_t
    FROM ranked WINDOW r AS (PARTITION BY method ORDER BY no ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING)),
  passed AS (SELECT method, max(no) AS no, twice FROM ranked WHERE twice IS NOT NULL GROUP BY method, twice),
  next AS (SELECT q.*, 2 * q.a AS double_a, len(s.hist) AS known FROM todo q JOIN s ON q.method = s.method AND q.rn > s.done AND q.rn <= s.done + 400),
  placed AS (SELECT n.*, 1 + coalesce((SELECT max(no) FROM passed p WHERE p.method = n.method AND p.twice < n.double_a), 0) AS run FROM next n),
  verdict AS (SELECT p.*, known >= 100 AND abs(p.t - (m * p.a + c)) > 3.25
      AND (abs(p.t - mean_t) > 20 OR (std_t > 0 AND abs(p.t - mean_t) / std_t > 4)) AS far
    FROM placed p LEFT JOIN line USING (method) LEFT JOIN runs r ON r.method = p.method AND r.no = p.run),
  counted AS (SELECT *, sum((NOT coalesce(far, FALSE))::INTEGER) OVER (PARTITION BY method ORDER BY rn) AS good,
      coalesce(far, FALSE) AS is_far FROM verdict),
  block AS (SELECT * FROM counted WHERE good - (NOT is_far)::INTEGER < CASE WHEN known < 100 THEN 100 - known ELSE 50 END)
  SELECT s.method, max(b.rn), (s.hist || coalesce(list({'a': b.a, 't': b.t} ORDER BY b.rn) FILTER (NOT is_far), []))[-1000:],
    s.bad || coalesce(list(b.obs_id) FILTER (is_far), [])
  FROM s JOIN block b USING (method) GROUP BY s.method, s.hist, s.bad)),
judged_in_order AS (SELECT obs_id, obs_id IN (SELECT unnest(bad) FROM fold) AS is_outlier FROM todo)"""
put("a17_outliers_in_order", [OBS, _IN_ORDER], "judged_in_order", "obs_id, is_outlier")
put("st5_refit_stream", [OBS, _IN_ORDER], "judged_in_order", "obs_id, is_outlier")
put("a18_datalink_summary", [REPORTS], "reports",
    """count(*) AS weather_messages, count(altitude_ft) AS with_altitude, count(temperature_c) AS with_temperature,
    count(*) FILTER (wind_dir_deg IS NOT NULL AND wind_speed_kt IS NOT NULL) AS with_wind,
    count(*) FILTER (altitude_ft IS NOT NULL AND temperature_c IS NOT NULL) AS complete_records,
    (SELECT count(*) FROM lines) AS total_messages""")
put("a19_position_statistics", [OBS, POS], "pos",
    """count(DISTINCT upper(trim(icao))) AS aircraft_count, count(*) AS total_entries, count(DISTINCT upper(trim(callsign))) AS callsign_mappings,
    count(*) AS message_counter""")
put("a20_message_distribution", [MSG, """d AS (
  SELECT 'df' AS dimension, df::VARCHAR AS value FROM msg
  UNION ALL SELECT 'typecode', typecode::VARCHAR FROM msg WHERE df IN (17, 18) AND typecode IS NOT NULL
  UNION ALL SELECT 'bds', CASE WHEN bds IN ('44', '50', '60') THEN 'BDS' || bds ELSE 'other' END FROM msg WHERE df IN (20, 21))"""],
    "d GROUP BY dimension, value", "dimension, value, count(*) AS messages")
put("a21_quality_rates", [OBS, LINES], "obs", "",
    """avg(coalesce(temperature > -100 AND temperature < 50 AND altitude > 0 AND altitude < 20000, FALSE)::INTEGER) AS valid_share
    | 1e0 - (SELECT count(*) FROM docs) / (SELECT count(*) FROM lines) AS parse_error_share""")
put("a22_source_counts", [OBS, "s AS (SELECT CASE method WHEN 'mode-s' THEN 'modes' ELSE 'vdl2' END AS source FROM obs)"],
    "s GROUP BY ROLLUP (source)", "source, count(*) AS records")

# --- windows, order, sets --------------------------------------------------------------------------
put("w1_first_per_group", [OBS, "f AS (SELECT DISTINCT ON (icao, method) icao, method, obs_id, time FROM obs ORDER BY icao, method, time DESC, obs_id DESC)"],
    "f", "icao, method, obs_id, time")
put("w2_last_known_values", [MSG], "state", "seq, icao, last_callsign", "last_altitude_ft | last_lat | last_lon | last_mach")
_SEG = """seg AS (SELECT b, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(b) OVER o AS b2 FROM hodo WINDOW o AS (ORDER BY b))"""
_SEGC = "x AS from_x | y AS from_y | x2 AS to_x | y2 AS to_y | ((b + 0.5e0) * 250 + (b2 + 0.5e0) * 250) / 2 AS segment_altitude"
put("w3_hodograph_segments", [OBS, FIT, _HODO.format("fit"), _SEG], "seg WHERE b2 IS NOT NULL",
    "(b * 250)::INTEGER AS altitude_bin", _SEGC)
put("w4_gap_islands", [OBS, FIT, _BANDS,
    "pts AS (SELECT band, time, epoch_us(time) AS t FROM fit JOIN bands ON altitude BETWEEN band - 100 AND band + 100)",
    "g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY band ORDER BY t) > 1799971200, TRUE)::INTEGER AS opens FROM pts)",
    "i AS (SELECT *, sum(opens) OVER (PARTITION BY band ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g)"],
    "i GROUP BY band, island", "band, island, min(time) AS first_time, max(time) AS last_time, count(*) AS n")
put("t1_range_fetch", [OBS, FIT, f"r AS (SELECT * FROM fit WHERE {_IN})"], "r",
    "time", "altitude | temperature | distance")
put("t1_range_fetch_truncated", [OBS, FIT], f"fit WHERE {_IN}", "count(*) AS rows, count(*) > 5000 AS truncated")
put("t2_measure_fetch", [OBS, FIT, f"r AS (SELECT * FROM fit WHERE {_IN})"], "r", "time", _GV)
put("t3_latest_rows", [OBS, """r AS (SELECT * FROM obs WHERE altitude IS NOT NULL AND temperature > -100 AND distance <= 100
  ORDER BY time DESC, obs_id DESC LIMIT 500)"""], "r", "time", "altitude | temperature | distance")
_INB = f"time_bucket >= {START} AND time_bucket <= {END}"
put("t4_grid_fetch_by_time", [OBS, FIT, HALF], f"half_hour WHERE {_INB} ORDER BY time", "time", _GV)
put("t4_grid_fetch_measures", [OBS, FIT, HALF], f"half_hour WHERE {_INB}", "time_bucket AS time", "altitude | temperature")
put("t5_merged_time_order", [OBS], "obs ORDER BY 2 NULLS LAST, 1",
    "obs_id, CASE WHEN method = 'vdl2' THEN time END AS time, method")
put("t6_fetch_summary", [OBS, FIT], f"fit WHERE {_IN}", "count(*) AS total_rows, min(time) AS min_time, max(time) AS max_time")
put("t6_fetch_sample", [OBS, FIT, f"r AS (SELECT * FROM fit WHERE {_IN} ORDER BY time LIMIT 3)"], "r", "time", "altitude | temperature")
put("t7_discrepancy_report", [OBS, _PAIRS,
    "r AS (SELECT * FROM bad ORDER BY modes_time, modes_obs_id, vdl2_time, vdl2_obs_id LIMIT 20)"],
    "r", "modes_obs_id, vdl2_obs_id", "time_diff_s | temp_diff_c")
put("u1_merged_observations", [MSG, _D44, REPORTS, f"""u AS (
  SELECT seq AS obs_id, 'mode-s' AS method, last_altitude_ft * 0.3048e0 AS altitude, t44 AS temperature,
    {_hav('dla', 'dlo')} AS distance FROM direct
  UNION ALL SELECT seq, 'vdl2', altitude_ft * 0.3048e0, temperature_c,
    CASE WHEN latitude IS NULL THEN 0 ELSE {_hav('latitude', 'longitude')} END
  FROM reports WHERE altitude_ft IS NOT NULL AND temperature_c IS NOT NULL)"""], "u",
    "obs_id, method", "altitude | temperature | distance")

# --- surface ------------------------------------------------------------------------------------------
_EXT = "ext AS (SELECT {0} AS t0, {1} AS t1 FROM {2})"
_FULL = _EXT.format("min(epoch_us(time))", "max(epoch_us(time))", "fit")


def _mesh(nodes: int, alts: int, top: float) -> str:
    return f"""mesh AS (SELECT i::INTEGER AS i, j::INTEGER AS j, (t0 + (t1 - t0) * i / {nodes - 1}e0) / 86400e6 AS mesh_day,
      j * ({top}e0 / {alts - 1}) AS mesh_altitude FROM ext, range({nodes}) a(i), range({alts}) b(j))"""


def _surface(rows: str, nodes: int, alts: int, top: float) -> str:
    """Every node with all its points, each taken about the node itself."""
    return f"""
placed AS (SELECT (epoch_us(time) - t0) * {nodes - 1}e0 / (t1 - t0) AS u, altitude / ({top}e0 / {alts - 1}) AS v,
    temperature AS z FROM {rows}, ext WHERE epoch_us(time) BETWEEN t0 AND t1 AND altitude BETWEEN 0 AND {top}),
shared AS (SELECT (floor(u + 0.5e0) - p)::INTEGER AS i, (floor(v + 0.5e0) - q)::INTEGER AS j, u, v, z
  FROM placed, range(-2, 3) a(p), range(-2, 3) b(q)),
moments AS (SELECT i, j, count(*) AS n, avg(u) - i AS mu, avg(v) - j AS mv, avg(z) AS mz, var_pop(u) AS uu,
    var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, z) AS uz, covar_pop(v, z) AS vz
  FROM shared WHERE i BETWEEN 0 AND {nodes - 1} AND j BETWEEN 0 AND {alts - 1} GROUP BY i, j),
fitted AS (SELECT i, j, mz - (uz * vv - vz * uv) / (uu * vv - uv * uv) * mu - (vz * uu - uz * uv) / (uu * vv - uv * uv) * mv AS value
  FROM moments WHERE n >= 3 AND uu * vv - uv * uv > 1e-2
    AND (mu * mu * vv - 2 * mu * mv * uv + mv * mv * uu) / (uu * vv - uv * uv) <= 8),
{_mesh(nodes, alts, top)},
surf AS (SELECT m.*, value FROM mesh m LEFT JOIN fitted f ON f.i = m.i AND f.j = m.j)"""


def _iso(low: int, high: int, step: int) -> str:
    return f"""
edges AS (
  SELECT i, j, 'time' AS edge, mesh_day AS d1, mesh_altitude AS a1, value AS v1, lead(mesh_day) OVER w AS d2,
    lead(mesh_altitude) OVER w AS a2, lead(value) OVER w AS v2 FROM surf WINDOW w AS (PARTITION BY j ORDER BY i)
  UNION ALL
  SELECT i, j, 'altitude', mesh_day, mesh_altitude, value, lead(mesh_day) OVER w,
    lead(mesh_altitude) OVER w, lead(value) OVER w FROM surf WINDOW w AS (PARTITION BY i ORDER BY j)),
crossed AS (SELECT *, level::INTEGER AS lvl, (level - v1) / (v2 - v1) AS share
  FROM edges JOIN range({low}, {high + 1}, {step}) l(level)
    ON level >= least(v1, v2) AND level < greatest(v1, v2))"""


_ISOC = "d1 + share * (d2 - d1) AS cross_day | a1 + share * (a2 - a1) AS cross_altitude"
put("g1_regular_mesh", [OBS, FIT, _FULL, _mesh(80, 80, 13000)], "mesh", "i, j", "mesh_day | mesh_altitude")
_G2 = _surface("fit", 80, 80, 13000)
put("g2_temperature_surface", [OBS, FIT, _FULL, _G2], "surf", "i, j", "mesh_day | mesh_altitude | value")
put("g2_temperature_surface_limited", [OBS, FIT, _FULL, _surface("fit", 80, 41, 2000)], "surf", "i, j",
    "mesh_day | mesh_altitude | value")
_HULL = """
pts AS MATERIALIZED (SELECT DISTINCT epoch_us(time) / 86400e6 AS x, altitude AS y FROM fit WHERE altitude BETWEEN 0 AND 13000),
lower AS ((SELECT x, y FROM pts ORDER BY x, y LIMIT 1) UNION ALL
  SELECT n.p.x, n.p.y FROM (SELECT arg_min({'x': p.x, 'y': p.y}, ((p.y - l.y) / (p.x - l.x), -p.x)) AS p
    FROM lower l JOIN pts p ON p.x > l.x) n WHERE n.p IS NOT NULL),
upper AS ((SELECT x, y FROM pts ORDER BY x, y DESC LIMIT 1) UNION ALL
  SELECT n.p.x, n.p.y FROM (SELECT arg_max({'x': p.x, 'y': p.y}, ((p.y - l.y) / (p.x - l.x), p.x)) AS p
    FROM upper l JOIN pts p ON p.x > l.x) n WHERE n.p IS NOT NULL),
sides AS (SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM lower
  UNION ALL SELECT x, y, lag(x) OVER (ORDER BY x), lag(y) OVER (ORDER BY x) FROM upper),
held AS (SELECT s.*, (SELECT count(*) FROM pts) >= 3 AND mesh_day BETWEEN (SELECT min(x) FROM pts) AND (SELECT max(x) FROM pts)
    AND NOT EXISTS (SELECT 1 FROM sides WHERE x2 IS NOT NULL
      AND (x2 - x1) * (s.mesh_altitude - y1) - (y2 - y1) * (s.mesh_day - x1) < 0) AS inside FROM surf s)"""
put("g2_surface_in_hull", [OBS, FIT, _FULL, _G2, _HULL], "held", "i, j, inside", "mesh_day | mesh_altitude | CASE WHEN inside THEN value END AS value")
put("g3_isotherms", [OBS, FIT, _FULL, _G2, _iso(-80, 30, 10)], "crossed", "i, j, edge, lvl AS level", _ISOC)

# Lines: every end, and every edge as the lowest of a closed line, is walked from; walks that get round, or to
# a higher end, are kept.
_LINES = """
cross_nodes AS MATERIALIZED (SELECT lvl, i, j, edge, (i * 1000000 + j) * 2 + (edge = 'altitude')::BIGINT AS node,
    d1 + share * (d2 - d1) AS cross_day, a1 + share * (a2 - a1) AS cross_altitude FROM crossed),
cells AS (SELECT a.i, a.j, a.value AS corner, (a.value + b.value + c.value + d.value) / 4 AS mean FROM surf a
  JOIN surf b ON b.i = a.i + 1 AND b.j = a.j JOIN surf c ON c.i = a.i AND c.j = a.j + 1 JOIN surf d ON d.i = a.i + 1 AND d.j = a.j + 1
  WHERE a.value + b.value + c.value + d.value IS NOT NULL),
sided AS (SELECT lvl, i, j, 'b' AS side, node FROM cross_nodes WHERE edge = 'time' UNION ALL SELECT lvl, i, j - 1, 't', node FROM cross_nodes WHERE edge = 'time'
  UNION ALL SELECT lvl, i, j, 'l', node FROM cross_nodes WHERE edge = 'altitude' UNION ALL SELECT lvl, i - 1, j, 'r', node FROM cross_nodes WHERE edge = 'altitude'),
faced AS (SELECT lvl, i, j, (mean > lvl) = (corner > lvl) AS alike, side, node, count(*) OVER (PARTITION BY lvl, i, j) AS n FROM sided JOIN cells USING (i, j)),
adj AS MATERIALIZED (SELECT x.lvl, x.node AS p, y.node AS q FROM faced x JOIN faced y ON x.lvl = y.lvl AND x.i = y.i AND x.j = y.j AND x.node <> y.node
  WHERE x.n = 2 OR x.side || y.side IN (SELECT unnest(CASE WHEN x.alike THEN ['br', 'rb', 'lt', 'tl'] ELSE ['bl', 'lb', 'tr', 'rt'] END))),
deg AS (SELECT lvl, p, count(*) AS n, min(q) AS near FROM adj GROUP BY lvl, p),
walk AS (SELECT a.lvl, a.p AS start, a.p AS prev, a.q AS node, 1 AS position, n = 2 AS loop FROM adj a JOIN deg d ON d.lvl = a.lvl AND d.p = a.p WHERE n = 1 OR q = near
  UNION ALL SELECT w.lvl, w.start, w.node, a.q, w.position + 1, w.loop FROM walk w JOIN adj a ON a.lvl = w.lvl AND a.p = w.node AND a.q <> w.prev
    WHERE w.node <> w.start AND (NOT w.loop OR w.node > w.start)),
whole AS (SELECT lvl, start, loop FROM walk GROUP BY lvl, start, loop
  HAVING CASE WHEN loop THEN count_if(node = start) > 0 ELSE start < arg_max(node, position) END),
placed_points AS (SELECT lvl, start, loop, position, node FROM walk JOIN whole USING (lvl, start, loop) WHERE node <> start
  UNION ALL SELECT lvl, start, loop, 0, start FROM whole)"""
put("g3_contour_lines", [OBS, FIT, _FULL, _G2, _iso(-80, 30, 10), _LINES], "placed_points JOIN cross_nodes USING (lvl, node)",
    "lvl AS level, start AS line, position::INTEGER AS position, loop AS closed", "cross_day | cross_altitude")

# --- streams whose outcome a batch statement can give ---------------------------------------------------
put("st6_grid_upkeep", [OBS, FIT, HALF], "half_hour", "time_bucket, altitude_bin", "altitude")
put("st7_freshness", [OBS, _METHODS, _LAST, f"""
f AS (SELECT *, greatest(0, (epoch_us({NOW}) - epoch_us(last_received)) / 1e6) AS age,
    CASE method WHEN 'vdl2' THEN 28800 ELSE 60 END AS lim,
    (epoch_us({NOW}) - epoch_us(last_received)) // 60000000 AS mins FROM seen)"""], "f",
    "method, last_received, lim AS limit_seconds, coalesce(age > lim, TRUE) AS failed, "
    "coalesce(mins >= CASE method WHEN 'vdl2' THEN 360 ELSE 30 END, TRUE) AS stale", "age AS age_seconds")
put("st7_absence_alarms", [OBS, """
heard AS (SELECT DISTINCT method, epoch_us(time) AS at_us, CASE method WHEN 'vdl2' THEN 3600000000 ELSE 1800000000 END AS lim FROM obs),
gaps AS (SELECT *, coalesce(lead(at_us) OVER (PARTITION BY method ORDER BY at_us),
    ((SELECT max(at_us) FROM heard) // 1000 - 10000) * 1000) - at_us AS gap FROM heard)"""],
    "gaps WHERE gap > lim", "method, make_timestamp(at_us) AS last_received, make_timestamp(at_us + lim) AS due")
put("st8_quarantine", [OBS], "obs",
    "obs_id, CASE WHEN altitude IS NULL OR temperature IS NULL THEN 'quarantine' ELSE 'stored' END AS sink")
put("st9_bounded_history", [OBS,
    "h AS (SELECT * FROM obs WHERE altitude IS NOT NULL AND temperature > -100 ORDER BY time DESC, obs_id DESC LIMIT 300)"],
    "h", "obs_id", "altitude | temperature")

# --- views: periods that raw rows, the half-hour and the three-hour grid serve, on the local clock ----------
_PERIODS = {"raw": ("2024-01-08", "2024-01-15"), "half_hour": ("2024-01-01", "2024-01-31"),
            "three_hour": ("2023-11-01", "2024-02-29")}
_LOW_BANDS = "bands AS (SELECT * FROM (VALUES (500), (1000), (1500)) b(band))"


def _put_views(level: str, limited: bool, suffix: str) -> None:
    first, last = (f"TIMESTAMP '{d}'" for d in _PERIODS[level])
    table, micros = ("fit", "time") if level == "raw" else (level, "time_bucket")
    low = " AND altitude <= 2000" if limited else ""
    tenth = f"to_microseconds((epoch_us({last}) - epoch_us({first})) // 10)"
    rows = f"SELECT * REPLACE ({micros} + INTERVAL 9 HOUR AS time) FROM {table} WHERE {micros} >= {{}} AND {micros} <= {{}}{low}"
    g = [OBS, FIT, HALF, THREE, "g AS (" + rows.format(first, last) + ")",
         "wide AS (" + rows.format(f"{first} - {tenth}", f"{last} + {tenth}") + ")"]
    nine = "+ INTERVAL 9 HOUR"
    cut = _EXT.format(f"greatest(min(epoch_us(time)), epoch_us({first} {nine}))",
                      f"least(max(epoch_us(time)), epoch_us({last} {nine}))", "wide")
    top, alts, alts3 = (2000, 41, 41) if limited else (13000, 80, 60)
    iso, iso3 = ((-20, 40, 5), (-20, 40, 10)) if limited else ((-80, 30, 10), (-80, 30, 10))
    put("v1_scatter_2d" + suffix, g, "g", "time", "altitude | temperature")
    put("v2_scatter_3d" + suffix, g, "g", "", "epoch_us(time) / 86400e6 AS day_number | altitude | temperature")
    surface = [*g, cut, _surface("wide", 80, alts, top)]
    put("v3_contour_2d" + suffix, [*surface, _iso(*iso)], "crossed", "i, j, edge, lvl AS level", _ISOC)
    whole = _EXT.format("min(epoch_us(time))", "max(epoch_us(time))", "g")
    put("v4_contour_3d" + suffix, [*g, whole, _surface("g", 60, alts3, top), _iso(*iso3)], "crossed",
        "i, j, edge, lvl AS level", _ISOC)
    put("v5_density" + suffix, g, "g", "", "altitude | temperature")
    put("v6_heatmap" + suffix, surface, "surf", "i, j", "mesh_day | mesh_altitude | value")
    put("v7_temperature" + suffix, [*g, _LOW_BANDS if limited else _BANDS, _SERIES.format(time="time", rows="g")],
        "bins", _SCOLS, "mean_temperature", 9)
    field = _WF.format(low="", step=100 if limited else 200, last=19 if limited else 63).replace("FROM fit", "FROM g")
    put("v8_wind_direction" + suffix,
        [*g, field, "s AS (SELECT *, sqrt(wind_x * wind_x + wind_y * wind_y) AS wind_speed FROM field)"], "s",
        "time_bin, alt_bin, altitude_bin",
        f"""mean_day | wind_x | wind_y | wind_speed | {_TOWARD.format('wind_x', 'wind_y')} AS toward_angle
        | wind_x / nullif(wind_speed, 0) AS unit_x | wind_y / nullif(wind_speed, 0) AS unit_y
        | least(wind_speed, 100) AS shown_speed""")


for _level, _limited, _suffix in (
    ("half_hour", False, ""), ("half_hour", True, "_limited"), ("raw", False, "_raw"), ("three_hour", False, "_three_hour"),
):
    _put_views(_level, _limited, _suffix)

for _low, _suffix, _top in (("", "", "13000e0"), (" AND altitude <= 2000", "_limited", "2000e0")):
    _TAIL = f"""last AS (SELECT * FROM fit WHERE time >= TIMESTAMP '2024-01-30 21:00:00' AND time <= TIMESTAMP '2024-01-31'{_low}),
      tail AS (SELECT * FROM last WHERE (SELECT count(*) FROM last) >= 10),
      windy AS (SELECT * FROM tail WHERE {_WINDY}), blown AS (SELECT * FROM windy WHERE (SELECT count(*) FROM windy) >= 10)"""
    put("v9_temperature_profile" + _suffix, [OBS, FIT, _TAIL,
        "prof AS (SELECT floor(altitude / 250) AS b, median(temperature) AS m FROM tail GROUP BY b)",
        "ground AS (SELECT m + 6.5e0 * (b + 0.5e0) * 250 / 1000e0 AS surface FROM prof ORDER BY b LIMIT 1)",
        f"""drawn AS (SELECT 'median' AS line, (b + 0.5e0) * 250 AS altitude, m AS temperature FROM prof
        UNION ALL SELECT 'standard', p * ({_top} / 49), surface - 6.5e0 * (p * ({_top} / 49)) / 1000e0 FROM ground, range(50) r(p))"""],
        "drawn", "line", "altitude | temperature")
    put("v10_hodograph" + _suffix, [OBS, FIT, _TAIL, _HODO.format("blown"), _SEG], "seg WHERE b2 IS NOT NULL",
        "(b * 250)::INTEGER AS altitude_bin", _SEGC)

# --- streams folded row by row -----------------------------------------------------------------------------
_FOLD_COLS = ("callsign", "alt", "lat", "lon", "t44", "s44", "d44", "trk", "gs", "tas", "hdg", "mach")
_READY = """CASE WHEN callsign IS NULL OR alt IS NULL OR lat IS NULL THEN NULL WHEN t44 IS NOT NULL THEN 'bds44'
    WHEN trk IS NOT NULL AND hdg IS NOT NULL THEN 'bds50_60' END AS kind"""
_MERGED = ", ".join(
    f"coalesce(u.{c}, CASE WHEN f.kind IS NULL AND u.us - f.us <= 86400000000 THEN f.{c} END) AS {c}"
    for c in _FOLD_COLS
)
_LIVE = f"""
upd AS (
  SELECT seq, icao, epoch_us(time) AS us, row_number() OVER (PARTITION BY icao ORDER BY seq) AS n, callsign,
    CASE WHEN lat IS NOT NULL THEN altitude_ft END AS alt, lat, lon, t44,
    CASE WHEN t44 IS NOT NULL THEN s44 END AS s44, CASE WHEN t44 IS NOT NULL THEN d44 END AS d44,
    CASE WHEN at50 IS NOT NULL THEN trk END AS trk, CASE WHEN at50 IS NOT NULL THEN gs END AS gs,
    CASE WHEN at50 IS NOT NULL THEN tas END AS tas, CASE WHEN at60 IS NOT NULL THEN hdg END AS hdg,
    CASE WHEN at60 IS NOT NULL THEN mach END AS mach
  FROM used WHERE callsign IS NOT NULL OR lat IS NOT NULL OR t44 IS NOT NULL OR at50 IS NOT NULL OR at60 IS NOT NULL),
fold AS (
  SELECT seq, icao, us, n, {", ".join(_FOLD_COLS)}, {_READY} FROM upd WHERE n = 1
  UNION ALL
  SELECT *, {_READY} FROM (
    SELECT u.seq, u.icao, u.us, u.n, {_MERGED} FROM fold f JOIN upd u ON u.icao = f.icao AND u.n = f.n + 1)),
live AS (SELECT seq, icao, callsign, alt, lat AS la, lon AS lo, kind, t44, s44 * 0.514444e0 AS s, d44, trk,
    gs * 0.514444e0 AS gs, tas * 0.514444e0 AS air, hdg, mach FROM fold WHERE kind IS NOT NULL),
live_obs AS (SELECT *, CASE kind WHEN 'bds44' THEN t44 ELSE {_temp('air', 'mach')} END AS temperature,
    CASE kind WHEN 'bds44' THEN -s * sin(radians(d44)) ELSE {_PX} END AS wind_x,
    CASE kind WHEN 'bds44' THEN -s * cos(radians(d44)) ELSE {_PY} END AS wind_y FROM live)"""
put("j7_live_pairing", [MSG, _LIVE], "live_obs WHERE temperature >= -100", "seq AS obs_id, icao, callsign",
    f"alt * 0.3048e0 AS altitude | {_hav('la', 'lo')} AS distance | temperature | wind_x | wind_y")
put("st1_fragment_state", [MSG, _LIVE], "live GROUP BY icao, kind", "icao, kind AS data_source, count(*) AS reports")
put("st4_xid_fragment_stream", [REPORTS, _ASK.format("reports", ""), _XID.format(asking="asking")],
    "taken t JOIN reports r ON r.seq = t.seq", "t.seq, r.icao, xid_feet AS altitude_ft",
    "coalesce(xid_lat, r.latitude) AS latitude")
_ARRIVED = "time < TIMESTAMP '2024-01-15'"
put("st5_outlier_stream", [OBS,
    f"early AS (SELECT * FROM obs WHERE {_ARRIVED} AND altitude IS NOT NULL AND temperature >= -100)",
    f"""week AS (SELECT * FROM early WHERE time >= (SELECT date_trunc('day', min(time)) - INTERVAL 7 DAY FROM obs
      WHERE NOT {_ARRIVED} AND altitude IS NOT NULL))""",
    _HIST.format(rows="week"),
    "line AS (SELECT regr_slope(temperature, altitude) AS s, regr_intercept(temperature, altitude) AS i FROM hist)",
    f"""kept AS (SELECT obs_id, temperature FROM early UNION ALL
      SELECT obs_id, temperature FROM near, line WHERE NOT {_ARRIVED}
        AND NOT (abs(temperature - (s * altitude + i)) > 3.25 AND (abs(temperature - mean_t) > 20
          OR (std_t > 0 AND abs(temperature - mean_t) / std_t > 4))))"""],
    "kept", "obs_id", "temperature")

put("st9_stored_ring", [OBS,
    f"early AS (SELECT * FROM obs WHERE {_ARRIVED} AND altitude IS NOT NULL AND temperature >= -100)",
    "latest AS (SELECT * FROM early WHERE temperature > -100 ORDER BY time DESC, obs_id DESC LIMIT 300)",
    _HIST.format(rows="latest"),
    "line AS (SELECT regr_slope(temperature, altitude) AS s, regr_intercept(temperature, altitude) AS i FROM hist)",
    f"""kept AS (SELECT obs_id, time, altitude, temperature FROM early UNION ALL
      SELECT obs_id, time, altitude, temperature FROM near, line WHERE NOT {_ARRIVED}
        AND NOT (abs(temperature - (s * altitude + i)) > 3.25 AND (abs(temperature - mean_t) > 20
          OR (std_t > 0 AND abs(temperature - mean_t) / std_t > 4)))),
    ring AS (SELECT * FROM kept WHERE temperature > -100 ORDER BY time DESC, obs_id DESC LIMIT 300)"""],
    "ring", "obs_id", "altitude | temperature")

_REACHED = [OBS, POS, PROBES, _NEAR.format(k="seq", t="time", probes="probes")]
put("st3_nearest_position_stream", _REACHED, "probes LEFT JOIN near ON seq = probe", "seq, icao",
    "altitude_m | abs(off) / 1e6 AS gap_s")
put("st2_position_retention", _REACHED, "probes LEFT JOIN near ON seq = probe GROUP BY icao",
    "icao, count(altitude_m) AS matched, count(*) - count(altitude_m) AS unmatched", "max(abs(off)) / 1e6 AS widest_gap_s")

_ASKED = """
asked AS (SELECT obs_id AS seq, epoch_us(time) AS micros, CASE WHEN obs_id % 4 <> 0 THEN 'AB' || icao END AS icao,
    CASE WHEN obs_id % 4 = 0 THEN upper(callsign) END AS callsign FROM obs WHERE method = 'vdl2'),
gaps AS (SELECT seq, epoch_us(time) AS micros, upper(trim(icao)) AS icao, upper(trim(callsign)) AS callsign, altitude_m,
    coalesce(epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY upper(trim(icao)) ORDER BY time, seq) > 7200000000, TRUE) AS begins
  FROM pos),
spells AS (SELECT *, max(CASE WHEN begins THEN micros END) OVER (PARTITION BY icao ORDER BY micros, seq) AS since FROM gaps)"""
put("st2_history_answers", [OBS, POS, _ASKED, """
led AS (SELECT DISTINCT ON (a.seq) a.seq, g.icao FROM asked a JOIN spells g ON a.icao IS NULL AND g.callsign = a.callsign AND g.micros < a.micros
  ORDER BY a.seq, g.micros DESC, g.seq DESC),
near AS (SELECT DISTINCT ON (a.seq) a.seq, a.micros, a.callsign, s.altitude_m, abs(s.micros - a.micros) AS gap, s.icao, s.since
  FROM asked a LEFT JOIN led USING (seq) JOIN spells s ON s.icao = coalesce(a.icao, led.icao) AND abs(s.micros - a.micros) <= 3600000000
  ORDER BY a.seq, abs(s.micros - a.micros), s.micros DESC, s.seq DESC),
known AS (SELECT n.* FROM near n WHERE n.callsign IS NULL OR EXISTS (SELECT 1 FROM spells s
  WHERE s.icao = n.icao AND s.since = n.since AND s.callsign = n.callsign AND s.micros <= n.micros))"""],
    "asked a LEFT JOIN known k USING (seq) WHERE a.icao IS NOT NULL OR a.callsign IS NOT NULL", "a.seq", "altitude_m | gap / 1e6 AS gap_s")
put("st2_history_state", [OBS, POS, _ASKED, """
mark AS (SELECT (least((SELECT max(micros) FROM spells), (SELECT max(micros) FROM asked)) // 1000 - 10000) * 1000 - 7200000000 AS old),
held AS (SELECT 'position' AS kind, icao, NULL::VARCHAR AS callsign, seq, micros, since FROM spells, mark WHERE micros > old
  UNION ALL SELECT 'callsign', icao, callsign, NULL, until, since FROM (
    SELECT icao, since, max(micros) AS until FROM spells GROUP BY icao, since) ends
    JOIN (SELECT DISTINCT icao, since, callsign FROM spells WHERE callsign IS NOT NULL) names USING (icao, since), mark WHERE until > old)"""],
    "held", "kind, icao, callsign, seq, micros, since")

put("live_collection", [*_CASCADE, MSG, _LIVE, """both_methods AS (
  SELECT c.seq AS obs_id, 'vdl2' AS method, c.altitude_ft * 0.3048e0 AS altitude, temperature_c::DOUBLE AS temperature
  FROM cascade c JOIN reports r ON r.seq = c.seq WHERE altitude_source IS NOT NULL AND temperature_c >= -100
  UNION ALL SELECT seq, 'mode-s', alt * 0.3048e0, temperature FROM live_obs WHERE temperature >= -100)"""],
    "both_methods", "obs_id, method", "altitude | temperature")

# --- the whole replay: positions from messages and XIDs, both methods, outliers against all that is clean ------
_SHIFT = 10_000_000_000
_RPOS = f"""
rep AS (SELECT * REPLACE (seq + {_SHIFT} AS seq) FROM reports),
pos AS (
  SELECT seq, time, icao, last_callsign AS callsign, last_altitude_ft * 0.3048e0 AS altitude_m,
    last_lat AS latitude, last_lon AS longitude
  FROM state WHERE altitude_ft IS NOT NULL OR (callsign IS NOT NULL AND last_altitude_ft IS NOT NULL)
  UNION ALL
  SELECT seq + {_SHIFT}, received_at, icao, NULL, altitude_ft * 0.3048e0, latitude, longitude
  FROM xid WHERE altitude_ft <> 0 AND seq NOT IN (SELECT seq FROM reports))"""
_REPLAYED = f"""
replayed AS (
  SELECT n.seq, temperature_c::DOUBLE AS temperature, CASE WHEN coalesce(n.altitude_ft, 0) > 0 THEN n.altitude_ft
      ELSE trunc(altitude_m / 0.3048e0)::INTEGER END AS feet FROM named n LEFT JOIN near ON n.seq = probe),
obs AS (
  SELECT seq AS obs_id, 'mode-s' AS method, 'bds44' AS data_source, last_altitude_ft * 0.3048e0 AS altitude,
    t44 AS temperature FROM direct WHERE last_altitude_ft > 0
  UNION ALL
  SELECT seq, 'mode-s', 'bds50_60', last_altitude_ft * 0.3048e0, {_temp('air', 'mach')} FROM paired
  WHERE last_altitude_ft > 0
  UNION ALL
  SELECT seq, 'vdl2', 'acars', feet * 0.3048e0, temperature FROM replayed WHERE feet > 0)"""
put("u1_replay", [
    MSG, _PAIR, _D44, REPORTS, _RPOS, _IDS, _NAMED.replace("FROM reports r", "FROM rep r"),
    _ORDER.format(probes="lookup", cond=_BACK), _REPLAYED,
    _HIST.format(rows="judged").replace("near AS (", "runs_near AS ("),
    "line AS (SELECT regr_slope(temperature, altitude) AS s, regr_intercept(temperature, altitude) AS i FROM hist)",
    """kept AS (SELECT * FROM runs_near, line WHERE NOT (abs(temperature - (s * altitude + i)) > 3.25
      AND (abs(temperature - mean_t) > 20 OR (std_t > 0 AND abs(temperature - mean_t) / std_t > 4))))"""],
    "kept", "obs_id, method, data_source", "altitude | temperature")
