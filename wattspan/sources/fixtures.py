"""Meter readings, raw lines and JSON messages derived from the ``events`` test table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.schema import BOUNDS, METRICS, RAW_METRICS

# The same text runs in Spark and in the checking engine.
READINGS_SQL = """
SELECT id, timestamp, site_id, 'meter-main' AS device_id,
  p AS global_active_power_kw,
  floor(p * 100 + 0.5) / 1000 AS global_reactive_power_kw,
  v AS voltage_v,
  floor(p * 10000 / v + 0.5) / 10 AS global_intensity_a,
  CASE WHEN id % 11 = 0 THEN 0.0 ELSE floor(p * (id % 5) * 10 + 0.5) / 10 END AS sub_metering_1_wh,
  CASE WHEN id % 11 = 0 THEN 0.0 ELSE floor(p * (id % 3) * 10 + 0.5) / 10 END AS sub_metering_2_wh,
  CASE WHEN id % 11 = 0 THEN 0.0 ELSE floor(p * (id % 7) * 10 + 0.5) / 10 END AS sub_metering_3_wh
FROM (SELECT event_id AS id, ts AS timestamp,
        CASE WHEN user_id % 10 < 8 THEN 'home-01' ELSE 'home-synth' END AS site_id,
        CASE WHEN event_id % 131 = 0 THEN CAST(0 AS DOUBLE) ELSE floor(value * 20 + 0.5) / 1000 END AS p,
        CAST(230 AS DOUBLE) + ((event_id * 7919) % 2001 - 1000) / CAST(100 AS DOUBLE) AS v
      FROM {events}) e
"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = spark.sql(READINGS_SQL, events=events)
    return df.withColumns({m: F.col(m).cast("double") for m in METRICS})


def raw_lines(readings_df: DataFrame) -> DataFrame:
    """Readings as meter lines, with missing, malformed and out-of-range ones on either side."""
    i = F.col("id")
    day = F.when(i % 333 == 7, "31/02/2024").otherwise(F.date_format("timestamp", "dd/MM/yyyy"))
    fields = [F.concat_ws(";", day, F.date_format("timestamp", "HH:mm:ss"))]
    for k, metric in enumerate(METRICS):
        low, high = BOUNDS[RAW_METRICS[k]]
        text = F.col(metric).cast("decimal(9,3)").cast("string")
        text = F.when(i % 400 == 20 + k, f"{low - 1:.3f}").when(i % 400 == 40 + k, f"{high + 1:.3f}").otherwise(text)
        if k == 2:
            text = F.when(i % 350 == 11, "abc").otherwise(text)
        fields.append(text)
    missing = F.concat(fields[0], F.lit(";?" * 7))
    line = (
        F.when(F.col("id") % 500 == 3, "bad;line")
        .when(F.col("id") % 80 == 0, missing)
        .otherwise(F.concat_ws(";", *fields))
    )
    return readings_df.select("id", line.alias("value"))


def messages(readings_df: DataFrame) -> DataFrame:
    """Readings as JSON telemetry messages, some of which break the contract."""
    i = F.col("id")
    value = F.when(i % 90 == 1, "-1.5").when(i % 80 == 12, '"1.5"').when(i % 80 == 13, "null").otherwise("1.5")
    power = F.when(i % 70 == 7, "").otherwise(F.concat(F.lit('"global_active_power_kw":'), value, F.lit(",")))
    version = F.when(i % 60 == 5, '"2.0"').when(i % 60 == 6, "1.0").otherwise('"1.0"')
    text = F.concat(
        F.lit('{"schema_version":'),
        version,
        F.lit(","),
        F.lit('"site_id":"'),
        F.when(i % 50 == 9, "Home 01").otherwise(F.col("site_id")),
        F.lit('",'),
        F.when(i % 40 == 3, "").otherwise('"device_id":"meter-main",'),
        F.when(i % 110 == 2, '"note":"x",').otherwise(""),
        F.lit('"timestamp":"'),
        F.when(i % 130 == 6, "yesterday").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")),
        F.lit('","metrics":{'),
        power,
        F.when(i % 120 == 4, '"phase":1,').otherwise(""),
        F.lit('"voltage_v":'),
        F.col("voltage_v").cast("decimal(9,2)").cast("string"),
        F.lit("}}"),
    )
    return readings_df.select("id", text.alias("value"))
