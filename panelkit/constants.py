"""Defaults shared by the operators."""

# Event types that the wide tables are built from.
KINDS = ("ACCIDENT", "JAM", "WEATHERHAZARD")

# Two parts around one comma, as in "state,county".
PAIR = r"^([^,]+),([^,]+)$"

# Thresholds and limits.
MIN_BASELINE = 10  # smaller baselines are suppressed
MAX_PERCENT_CHANGE = 500  # changes at or above this are dropped
OUTLIER_CAP = 10_000  # larger weather/hazard counts are data errors
ZERO_BELOW = {"ACCIDENT": 0.2, "JAM": 0.5, "WEATHERHAZARD": 0.5}
USABLE_COUNT = 10  # a usable day has more events than this
USABLE_SHARE = 0.2  # a usable place has more than this share of usable days
JUMPS_PERCENT = (200, 500, 1000)
MAX_JUMP_DAYS = 10
TOP_PERIODS = 5
TEST_SHARE = 0.30
CLASS_CUTOFF = 0.2
TROUGH_FROM_WEEK = 10

# Forest settings (trees, features per split, leaf size, depth).
FOREST = {
    "numTrees": 200,
    "featureSubsetStrategy": "8",
    "minInstancesPerNode": 100,
    "maxDepth": 9,
}

# Forecasting.
LAGS = 6
HORIZON = 12
SEASON = 12
