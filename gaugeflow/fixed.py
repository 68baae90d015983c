"""Fixed values that must equal the original service's for identical results.

Everything here is configuration, stated plainly in natural order.
"""

from __future__ import annotations

# --- Fixed values: sensor dimension of the original service -------------------------
# (sensor_id, type, location, normal_range min, normal_range max, unit)
SERVICE_SENSORS = [
    ("TEMP_001", "temperature", "Factory_Floor_A", 18.0, 25.0, "°C"),
    ("TEMP_002", "temperature", "Factory_Floor_B", 20.0, 28.0, "°C"),
    ("PRESS_001", "pressure", "Pipeline_1", 95.0, 105.0, "PSI"),
    ("PRESS_002", "pressure", "Pipeline_2", 98.0, 108.0, "PSI"),
    ("HUMID_001", "humidity", "Storage_Room_1", 45.0, 65.0, "%"),
    ("VIB_001", "vibration", "Motor_1", 0.1, 0.8, "mm/s"),
]

# --- Fixed values: normal ranges per event type for the `events` fixture --------------
EVENT_TYPE_RANGES = [
    ("view", 20.0, 100.0),
    ("click", 25.0, 110.0),
    ("purchase", 15.0, 90.0),
    ("signup", 20.0, 120.0),
    ("error", 30.0, 95.0),
]
EVENT_ZONES = 10  # sensor_id = event_type || '_' || (user_id % 10)

# --- Fixed values: Silver range rules ----------------------------------------------------
EXTENDED_LOW, EXTENDED_HIGH, EXTENDED_FACTOR = 0.5, 1.5, 0.5
EXTREME_LOW, EXTREME_HIGH, EXTREME_FACTOR = 0.2, 2.0, 0.1
MAGNITUDE_LIMIT, MAGNITUDE_FACTOR = 1000.0, 0.7
SENTINEL_LOW, SENTINEL_HIGH = -999.0, 999.0
SOURCE_NAME = "iot_sensors"

# --- Fixed values: feature engineering -------------------------------------------------
ROLLING_WINDOWS = [5, 10, 20, 50]
LAGS = [1, 2, 3, 5]
MIN_ROWS_FEATURES = 5
MIN_ROWS_TREND = 10
MIN_ROWS_TRAIN_SENSOR = 10
MIN_TRAIN_VECTORS = 51  # training needs more than 50 vectors
MAX_HISTORY = 100
FEATURE_VERSION = "v1.0"
MODEL_VERSION = "v1.0"

# --- Fixed values: detector -------------------------------------------------------------
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_SEED = 42
CONTAMINATION = 0.1
KMEANS_K = 3
KMEANS_COLUMNS = ["mean_5min", "std_5min", "range_5min", "count_5min"]

# --- Fixed values: streaming ------------------------------------------------------------
WINDOW_DURATION = "5 minutes"
WINDOW_SLIDE = "1 minute"
WATERMARK_DELAY = "10 minutes"

# numpy.nan_to_num replacement for +/-inf
DOUBLE_MAX = 1.7976931348623157e308


def feature_names(windows=ROLLING_WINDOWS, lags=LAGS) -> list[str]:
    """The 30 feature names, built from the window/lag parameters, sorted (vector layout)."""
    names = ["mean", "std", "min", "max", "range", "skewness", "kurtosis",
             "trend_slope", "last_change", "change_rate"]
    names += [f"lag_{k}" for k in lags]
    for w in windows:
        names += [f"rolling_{s}_{w}" for s in ("mean", "std", "max", "min")]
    return sorted(names)
