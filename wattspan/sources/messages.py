"""Telemetry messages (contract version 1.0): decoding and contract violations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.schema import METRICS, POWER

# The contract.
VERSION = "1.0"
KEYS = ["schema_version", "site_id", "device_id", "timestamp", "metrics"]
NAME_PATTERN = "^[a-z0-9-]+$"
MOMENT_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})?$"
# the types of JSON numbers
NUMBER_TYPE = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"

MESSAGE = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in KEYS[:-1]],
        T.StructField("metrics", T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])),
    ]
)


def _unknown_keys(keys: Column, known, label: str) -> Column:
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in known]))
    return F.transform(extra, lambda k: F.concat(F.lit(label), k))


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Typed message columns and ``violations``, the broken rules in contract order."""
    msg = F.col("_m")
    metrics = msg["metrics"]
    whole = F.try_parse_json(value)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{path}", "variant")), F.lit(""))
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    inner = F.coalesce(F.json_object_keys(F.get_json_object(value, "$.metrics")), F.array().cast("array<string>"))
    rules = [F.when(~F.array_contains(keys, k), F.lit(f"missing {k}")) for k in KEYS]
    rules.append(F.when(~F.array_contains(inner, POWER), F.lit(f"missing metrics.{POWER}")))
    rules += [F.when(F.array_contains(keys, k) & ~kind(k).startswith("STRING"), F.lit(f"{k} is not a string")) for k in KEYS[:-1]]
    rules.append(F.when(F.array_contains(keys, "metrics") & ~kind("metrics").startswith("OBJECT"), F.lit("metrics is not an object")))
    rules += [F.when(F.array_contains(inner, m) & ~kind(f"metrics.{m}").rlike(NUMBER_TYPE), F.lit(f"metrics.{m} is not a number")) for m in METRICS]
    rules.append(F.when(msg["schema_version"] != VERSION, F.lit("schema_version is not 1.0")))
    rules += [F.when(~msg[k].rlike(NAME_PATTERN), F.lit(f"{k} is not a valid name")) for k in ("site_id", "device_id")]
    rules.append(F.when(~msg["timestamp"].rlike(MOMENT_PATTERN), F.lit("timestamp is not a date-time")))
    rules += [F.when(metrics[m] < 0, F.lit(f"metrics.{m} is below 0")) for m in METRICS]
    violations = F.concat(
        F.array_compact(F.array(*rules)),
        _unknown_keys(keys, KEYS, "unknown key "),
        _unknown_keys(inner, METRICS, "unknown key metrics."),
    )
    # a generated row is decoded once, however many rules look at it
    return df.withColumn("_m", F.explode(F.array(F.from_json(value, MESSAGE)))).select(
        *df.columns,
        *[msg[k].alias(k) for k in KEYS[:-1]],
        *[metrics[m].alias(m) for m in METRICS],
        violations.alias("violations"),
    )
