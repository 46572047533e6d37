"""Fixed values of the weather-observation model.

Every number here decides a result, so it is stated once, as is.
"""

# --- Fixed values: unit conversions -------------------------------------
FEET_TO_METRES = 0.3048
KNOTS_TO_MS = 0.514444
KM_PER_DEGREE = 111.0
EARTH_RADIUS_KM = 6371.0

# --- Fixed values: air properties ---------------------------------------
HEAT_RATIO_AIR = 1.403
MOLAR_MASS_AIR = 28.966e-3
GAS_CONSTANT = 8.314472
KELVIN_OFFSET = 273.15

# --- Fixed values: magnetic declination, quadratic about (37N, 138E) -----
# coefficients in degrees: constant, lat, lon, lat^2, lat*lon, lon^2
DECLINATION_ORIGIN = (37.0, 138.0)
DECLINATION_TERMS = (
    8 + 15.822 / 60,
    18.462 / 60,
    -7.726 / 60,
    0.007 / 60,
    0.007 / 60,
    -0.655 / 60,
)

# --- Fixed values: default receiver site and filters ---------------------
REFERENCE_LATITUDE = 35.682677
REFERENCE_LONGITUDE = 139.762230
DISTANCE_LIMIT_KM = 100.0
TEMPERATURE_FLOOR_C = -100.0
ALTITUDE_MIN_M = 0.0
ALTITUDE_MAX_M = 13000.0
ALTITUDE_LIMITED_M = 2000.0
CALM_WIND_MS = 0.1
MIN_SAMPLES = 10

# --- Fixed values: reception methods --------------------------------------
MODE_S = "mode-s"
VDL2 = "vdl2"
METHODS = (MODE_S, VDL2)

# --- Fixed values: observation columns that may be requested ---------------
OBSERVATION_COLUMNS = (
    "time",
    "callsign",
    "distance",
    "altitude",
    "latitude",
    "longitude",
    "temperature",
    "wind_x",
    "wind_y",
    "wind_angle",
    "wind_speed",
    "method",
)
DEFAULT_COLUMNS = ("time", "altitude", "temperature", "distance")
WIND_COLUMNS = ("wind_x", "wind_y", "wind_speed", "wind_angle")
GRID_VALUES = ("time", "altitude", "temperature") + WIND_COLUMNS

# --- Fixed values: matching windows ---------------------------------------
POSITION_WINDOW_S = 60
ORDER_WINDOW = 1000
FRAGMENT_TTL_S = 300
FRAGMENT_EVICT_S = 600
EXACT_MATCH_S = 1.0

# --- Fixed values: down-sampled grids ---------------------------------------
LOCAL_ZONE = "Asia/Tokyo"
ALTITUDE_BIN_M = 250
HALF_HOUR_S = 30 * 60
THREE_HOUR_S = 3 * 60 * 60
HALF_HOUR_REFRESH_S = 3 * 60 * 60
THREE_HOUR_REFRESH_S = 12 * 60 * 60
RAW_MAX_DAYS = 14
HALF_HOUR_MAX_DAYS = 90
RANGE_EXTENSION = 0.1
PERIOD_PRESETS_DAYS = (1, 7, 30, 180, 365)

# --- Fixed values: views -----------------------------------------------------
PROFILE_WINDOW_H = 3
LAPSE_RATE_C_PER_KM = 6.5
PROFILE_LINE_POINTS = 50
TEMPERATURE_BANDS = ((1400, 1600), (2900, 3100), (4400, 4600), (5900, 6100))
TEMPERATURE_BANDS_LIMITED = ((400, 600), (900, 1100), (1400, 1600))
SERIES_BIN_MICROS = 1_799_971_200  # 0.020833 day
WIND_ALTITUDE_STEP_M = 200
WIND_ALTITUDE_LAST_BIN = 63
WIND_ALTITUDE_STEP_LIMITED_M = 100
WIND_ALTITUDE_LAST_BIN_LIMITED = 19
WIND_SPEED_SCALE_MAX = 100.0
MESH_NODES = 80
MESH_NODES_3D = 60
MESH_ALTITUDE_STEP_LIMITED_M = 50
ISOTHERM_RANGE = (-80, 30, 10)
ISOTHERM_RANGE_LIMITED = (-20, 40, 5)

# --- Fixed values: outlier rule -----------------------------------------------
HISTORY_MIN = 100
HISTORY_SIZE = 30_000
REFIT_ROWS = 50
NEIGHBOURS = 200
DEVIATION_LIMIT_C = 20.0
SIGMA_LIMIT = 4.0
RESIDUAL_TOLERANCE_C = 0.0065 * 200 * 2.5

# --- Fixed values: cross-source comparison ----------------------------------
COMPARE_WINDOW_S = 300
COMPARE_ALTITUDE_M = 500.0
COMPARE_TEMPERATURE_C = 10.0
COMPARE_SPEED_MS = 10.0
COMPARE_DIRECTION_DEG = 45.0
REPORT_ROWS = 20

# --- Fixed values: freshness limits, seconds ----------------------------------
DAY_HOURS = (7, 22)
FRESH_DAY_S = 60
FRESH_NIGHT_S = 3600
FRESH_VDL2_S = 8 * 60 * 60
STALE_MODE_S_S = 30 * 60
STALE_VDL2_S = 6 * 60 * 60
