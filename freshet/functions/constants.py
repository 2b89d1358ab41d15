"""Fixed values that results depend on."""

# Roots of the two public APIs and the identifiers below them.
HYDROLOGY_ROOT = "http://environment.data.gov.uk/hydrology"
FLOOD_ROOT = "http://environment.data.gov.uk/flood-monitoring"
MEASURE_PREFIX = HYDROLOGY_ROOT + "/id/measures/"
STATION_PREFIX = HYDROLOGY_ROOT + "/id/stations/"
ROOT_TEMPLATE = "{root}"

# Cell texts read as missing in every CSV column.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Characters removed at both ends of a text before parsing.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Limits for the last part of a split measurement.
SPLIT_MIN = -9999999.0
SPLIT_MAX = 9999999.0

# Code maps of the reading attributes.
DATUM_TYPES = {
    "mAOD": "{root}/def/core/datumAOD",
    "mASD": "{root}/def/core/datumASD",
    "mBDAT": "{root}/def/core/datumBDAT",
}
PERIOD_SECONDS = {
    "5_min": 300,
    "15_min": 900,
    "30_min": 1800,
    "1_h": 3600,
    "Unspecified": 0,
}
VALUE_TYPES = {
    "i": "instantaneous",
    "t": "total",
    "max": "max",
    "min": "min",
    "Mean": "mean",
    "Event": "event",
    "Cumulative_Total": "cumulative total",
}
QUALIFIERS = {
    "crest_tapping": "Crest Tapping",
    "direction": "Direction",
    "downstage": "Downstream Stage",
    "dry_bulb": "Dry Bulb",
    "groundwater": "Groundwater",
    "height": "Height",
    "logged": "Logged",
    "reservoir_level": "Reservoir Level",
    "speed": "Speed",
    "stage": "Stage",
    "sump_level": "Sump Level",
    "tidal_level": "Tidal Level",
    "tipping_bucket_raingauge": "Tipping Bucket Raingauge",
    "water": "Water",
    "wet_bulb": "Wet Bulb",
}

# Observed properties a reading query may name.
OBSERVED_PROPERTIES = (
    "waterFlow", "waterLevel", "rainfall", "groundwaterLevel",
    "dissolved-oxygen", "fdom", "bga", "turbidity", "chlorophyll",
    "conductivity", "temperature", "ammonium", "nitrate", "ph",
)

# Most rows one request returns, per kind of document.
SOURCE_LIMITS = {
    "readings": 1_000_000,
    "hydrology_stations": 20_000,
    "hydrology_measures": 50_000,
    "flood_stations": 20_000,
    "flood_measures": 50_000,
    "flood_areas": 10_000,
}

# Load window rules, in days, and the first day of an empty table.
LOOP_LAG_DAYS = 3
TRAILING_DAYS = 14
FIRST_DAY = "2022-01-01"

#: codes of ``value_status``; 4 is not in use
VALUE_STATUSES = (0, 1, 2, 3, 5, 6, 7, 8)
