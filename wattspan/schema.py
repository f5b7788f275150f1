"""Column names, physical bounds and table schema shared by every operator."""

from pyspark.sql import types as T

SITE, DEVICE, TS, ID = "site_id", "device_id", "timestamp", "id"

# The metric names of a raw meter line, in field order, with the
# inclusive physical range used for warnings.
BOUNDS = {
    "global_active_power": (0.0, 15.0),
    "global_reactive_power": (0.0, 5.0),
    "voltage": (100.0, 300.0),
    "global_intensity": (0.0, 80.0),
    "sub_metering_1": (0.0, 100.0),
    "sub_metering_2": (0.0, 100.0),
    "sub_metering_3": (0.0, 100.0),
}
RAW_METRICS = list(BOUNDS)

# The same metrics as table columns, with their unit suffix.
METRICS = [
    "global_active_power_kw",
    "global_reactive_power_kw",
    "voltage_v",
    "global_intensity_a",
    "sub_metering_1_wh",
    "sub_metering_2_wh",
    "sub_metering_3_wh",
]
POWER = METRICS[0]
VOLTAGE = METRICS[2]
CURRENT = METRICS[3]
SUB_METERS = METRICS[4:]

# The identity and order of a reading; the order key breaks timestamp ties.
READING_KEYS = [ID, TS, SITE, DEVICE]
ORDER = [TS, ID]

READINGS_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.LongType()),
        T.StructField(TS, T.TimestampNTZType()),
        T.StructField(SITE, T.StringType()),
        T.StructField(DEVICE, T.StringType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("ingested_at", T.TimestampType()),
    ]
)
