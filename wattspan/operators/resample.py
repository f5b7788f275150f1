"""Time buckets: means, bands, counts, weekly means and complete spines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.functions.clock import DAY_US, calendar_unit, floor_to, from_micros, micros, midnight, rule_micros
from wattspan.schema import METRICS, POWER, SITE, SUB_METERS, TS, VOLTAGE

SPINE_STEP = 4096

# Nominal voltage and its ten percent limits; names of the sub-meters.
NOMINAL_V, LOW_V, HIGH_V = 230.0, 207.0, 253.0
METER_LABELS = {"sub_metering_1_wh": "Kitchen", "sub_metering_2_wh": "Laundry", "sub_metering_3_wh": "Water/AC"}


def with_bucket(df: DataFrame, rule: str, keys=(SITE,)) -> DataFrame:
    """Add ``bucket``: left-closed, left-labelled, counted from midnight of the key's first day.

    Weeks and months are labelled by their last day. Steps that divide a day fall on the same grid from any midnight, so only
    other steps have to look up the first day.
    """
    unit = calendar_unit(rule)
    if unit:
        # weeks end on Sunday; both are labelled by their last day
        day = F.to_date(TS)
        end = F.date_add(day, 6 - F.weekday(day)) if unit == "week" else F.last_day(day)
        return df.withColumn("bucket", end.cast("timestamp_ntz"))
    step = rule_micros(rule)
    if DAY_US % step == 0:
        return df.withColumn("bucket", floor_to(TS, step))
    first = df.groupBy(*keys).agg(midnight(F.min(TS)).alias("_origin"))
    return df.join(durable(first, "origins"), list(keys)).withColumn("bucket", floor_to(TS, step, "_origin")).drop("_origin")


def resample(df: DataFrame, rule: str, aggregates, keys=(SITE,)) -> DataFrame:
    """Aggregate each non-empty bucket; partial aggregation shrinks the data before the shuffle."""
    return with_bucket(df, rule, keys).groupBy(*keys, "bucket").agg(*aggregates)


def spine(buckets: DataFrame, rule: str, keys=(SITE,)) -> DataFrame:
    """Every bucket from a key's first to its last, built in short runs."""
    ends = buckets.groupBy(*keys).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    unit = calendar_unit(rule)
    if unit:
        apart = F.expr("INTERVAL 7 DAYS" if unit == "week" else "INTERVAL 1 MONTH")
        every = ends.select(*keys, F.explode(F.sequence(F.to_date("_a"), F.to_date("_b"), apart)).alias("day"))
        day = F.col("day") if unit == "week" else F.last_day("day")
        return every.select(*keys, day.cast("timestamp_ntz").alias("bucket"))
    step = rule_micros(rule)
    last = F.floor((micros("_b") - micros("_a")) / F.lit(step))
    runs = ends.withColumn("_last", last).withColumn(
        "_run", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / SPINE_STEP)))
    )
    inside = F.sequence(
        F.col("_run") * SPINE_STEP, F.least(F.col("_run") * SPINE_STEP + SPINE_STEP - 1, F.col("_last"))
    )
    steps = runs.withColumn("_i", F.explode(inside))
    return steps.select(*keys, from_micros(micros("_a") + F.col("_i") * step).alias("bucket"))


def resample_full(df: DataFrame, rule: str, aggregates, keys=(SITE,)) -> DataFrame:
    """Like ``resample`` but with a null row for each empty bucket."""
    filled = resample(df, rule, aggregates, keys)
    return spine(filled, rule, keys).join(filled, [*keys, "bucket"], "left")


def means(columns=tuple(METRICS)):
    return [F.avg(c).alias(c) for c in columns]


def resample_mean(df: DataFrame, rule: str, keys=(SITE,), columns=tuple(METRICS)) -> DataFrame:
    return resample(df, rule, means(columns), keys).dropna("any", subset=list(columns))


def resample_mean_full(df: DataFrame, rule: str, keys=(SITE,), columns=tuple(METRICS)) -> DataFrame:
    return resample_full(df, rule, means(columns), keys)


def voltage_band(df: DataFrame, rule: str | None, keys=(SITE,)) -> DataFrame:
    """Mean, lowest and highest voltage per bucket with the nominal limits; raw values without a rule."""
    if rule is None:
        out = df.select(*keys, F.col(TS).alias("bucket"), F.col(VOLTAGE).alias("mean"))
    else:
        stats = [F.avg(VOLTAGE).alias("mean"), F.min(VOLTAGE).alias("min"), F.max(VOLTAGE).alias("max")]
        out = resample_full(df, rule, stats, keys)
    return out.withColumns({"nominal": F.lit(NOMINAL_V), "lower": F.lit(LOW_V), "upper": F.lit(HIGH_V)})


def daily_counts(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Readings per calendar day, zero for days without any."""
    counted = resample_full(df, "1D", [F.count(F.lit(1)).alias("readings")], keys)
    return counted.select(*keys, F.to_date("bucket").alias("day"), F.coalesce("readings", F.lit(0)).alias("readings"))


def weekly_mean(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Mean power of each Monday-to-Sunday week, labelled by its Sunday; empty weeks are null."""
    day = F.to_date(TS)
    sunday = F.date_add(day, 6 - F.weekday(day))
    weeks = df.groupBy(*keys, sunday.alias("week")).agg(F.avg(POWER).alias("mean_kw"))
    ends = weeks.groupBy(*keys).agg(F.min("week").alias("_a"), F.max("week").alias("_b"))
    every = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return every.join(weeks, [*keys, "week"], "left")


def submeter_stack(df: DataFrame, rule: str, keys=(SITE,)) -> DataFrame:
    """Mean of each sub-meter per bucket in long form."""
    wide = resample_mean_full(df, rule, keys, tuple(SUB_METERS))
    long = wide.unpivot([*keys, "bucket"], list(SUB_METERS), "meter", "mean_wh")
    label = F.create_map(*[F.lit(x) for pair in METER_LABELS.items() for x in pair])
    return long.withColumn("label", label[F.col("meter")])
