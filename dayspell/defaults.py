"""Default parameters. Each operator takes them as keyword arguments."""

# Fixed values of the method (years, thresholds, radii, constants).
BASELINE = (1951, 1980)
MIN_BASE_YEARS_STATION = 15
MIN_BASE_YEARS_CELL = 20
MIN_BASE_YEARS_BAND = 15
MONTH_COMPLETENESS = 0.80
MIN_MONTH_DAYS = 20
MIN_JJA_DAYS = 75

JJA = (6, 7, 8)
MAY_SEP = (5, 6, 7, 8, 9)
SEASON_DAYS = 153
RECORD_YEARS = (1900, 2025)
MASTER_YEARS = (1900, 2026)
RECORD_BOUNDS = (-40.0, 57.0)
STATION_MONTH_BOUNDS = (-60.0, 60.0)
RECORD_MIN_YEARS = 100
RECORD_MIN_SHARE = 0.80
MIN_CELL_FRACTION = 0.50
MIN_LAND_FRACTION = 0.50

EXCEED_PERCENTILE = 95.0
EXCEED_WINDOW_BEFORE = 14
EXCEED_WINDOW_AFTER = 16
DUST_BOWL = (1930, 1939)
RECENT = (2015, 2024)

HEAT_PERCENTILE = 90
HEAT_HALF_WINDOW = 3
HEAT_MIN_RUN = 6
HEAT_MIN_SHARE = 0.70
HEAT_MIN_POOL = 201

IDW_POWER = 2.0
IDW_NEIGHBOURS = 8
IDW_RADIUS_KM = 150.0
COUNT_IDW_RADIUS_CONUS_KM = 115.0
COUNT_IDW_RADIUS_BAND_KM = 300.0
COUNT_IDW_MIN_STATIONS = 2
COUNT_IDW_SOLO = 1.5
EARTH_RADIUS_KM = 6371.0088
RADIAL_EARTH_RADIUS_KM = 6335.44

LOWESS_YEARS = 17
LOWESS_PASSES = 0
MAD_K = 8.0
TAIL_Z = 6.0
MAD_SCALE = 1.4826
MIN_AREA_FRACTION = 0.50
PERIOD_MIN_YEARS = 7
TREND_STARTS = (1900, 1920, 1940, 1955, 1960, 1970, 1980, 1990)

CONUS_BOX = {"lat_min": 24.0, "lat_max": 50.0, "lon_min": -125.0, "lon_max": -66.0}
BAND_LAT = (24.0, 50.0)
GRID_DEGREES = 2.0
