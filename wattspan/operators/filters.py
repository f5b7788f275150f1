"""Row filters: ranges, presets, bounds, samples, spikes, dropouts and slices."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.functions.clock import from_micros, micros, midnight
from wattspan.operators.ordering import last_rows, number_rows
from wattspan.operators.quantiles import attach, exact_quantiles
from wattspan.schema import ID, METRICS, ORDER, POWER, SITE, TS, VOLTAGE
from wattspan.sources.readings import in_range

PRESET_DAYS = {"24h": 1, "7d": 7, "30d": 30, "all": None}
DAY_SECONDS = 86_400


def by_site(df: DataFrame, site_id: str = "home-01") -> DataFrame:
    return df.where(F.col(SITE) == site_id)


def by_days(df: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """Whole days from start date to end date; midnight after the end date is out."""
    end = F.date_add(F.lit(end_date).cast("date"), 1).cast("timestamp_ntz")
    return in_range(df, F.lit(start_date).cast("date").cast("timestamp_ntz"), end, half_open=True)


def last_hours(df: DataFrame, hours: int = 24, keys=(SITE,)) -> DataFrame:
    """The last ``hours * 60`` rows of each site; an hour is sixty rows, gaps or not."""
    if not 1 <= hours <= 168:
        raise ValueError("hours must be between 1 and 168")
    return last_rows(df, hours * 60, keys)


def last_hours_by_clock(df: DataFrame, hours: int = 24, keys=(SITE,)) -> DataFrame:
    """The readings of the last ``hours`` of clock time before each site's newest one."""
    newest = df.groupBy(*keys).agg(F.max(TS).alias("_newest"))
    span = F.lit(hours * 3600 * 1_000_000)
    return attach(df, newest, keys).where(micros(TS) > micros("_newest") - span).drop("_newest")


def by_preset(df: DataFrame, preset: str = "7d", keys=(SITE,)) -> DataFrame:
    """Whole days of a preset that ends with each site's newest reading."""
    days = PRESET_DAYS[preset]
    ends = df.groupBy(*keys).agg(F.min(TS).alias("_first"), F.max(TS).alias("_last"))
    start = F.col("_first") if days is None else from_micros(micros("_last") - F.lit(days * DAY_SECONDS * 1_000_000))
    limits = ends.select(*keys, midnight(start).alias("_from"), (midnight("_last")).alias("_to"))
    day_us = F.lit(DAY_SECONDS * 1_000_000)
    chosen = (F.col(TS) >= F.col("_from")) & (micros(TS) < micros("_to") + day_us)
    return attach(df, limits, keys).where(chosen).drop("_from", "_to")


def input_violations() -> Column:
    """Rules a reading must meet to be scored: nothing missing or negative, voltage above zero."""
    rules = [F.when(F.col(TS).isNull(), F.lit(f"{TS} is missing"))]
    for metric in METRICS:
        value = F.col(metric)
        low = (value <= 0) if metric == VOLTAGE else (value < 0)
        limit = "greater than 0" if metric == VOLTAGE else "at least 0"
        rules.append(F.when(value.isNull(), F.lit(f"{metric} is missing")).when(low, F.lit(f"{metric} must be {limit}")))
    return F.array_compact(F.array(*rules))


def exact_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * n) rows, chosen by the order of a hash of their id.

    The digest of the last row of the sample is found from counts: first the slot of
    16 bits that holds it, then its rank within the slot. Rows are then only
    compared with it, so none is shuffled; rows whose digests are equal are told apart by
    their id.
    """
    digest = F.md5(F.concat_ws(":", F.col(ID), F.lit(seed)))
    drawn = df.select(digest.alias("_digest"), F.col(ID).alias("_id")).withColumn("_b", F.substring("_digest", 1, 4))
    # 65,536 slots at most, whatever the size of the data
    slots = durable(drawn.groupBy("_b").agg(F.count(F.lit(1)).alias("_in_slot")), "slots")
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = slots.select(F.round(F.lit(fraction) * F.sum("_in_slot")).cast("long").alias("_k"))
    slots = slots.withColumn("_before", F.coalesce(F.sum("_in_slot").over(ahead), F.lit(0))).withColumn("_k", wanted.scalar())
    edge = slots.where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_in_slot") >= F.col("_k"))).first()
    if edge is None:
        return df.limit(0)
    left = edge["_k"] - edge["_before"]
    last = drawn.where(F.col("_b") == edge["_b"]).orderBy("_digest", "_id").limit(left)
    last = last.agg(F.max(F.struct("_digest", "_id")).alias("m")).first()["m"]
    return df.where((digest < last["_digest"]) | ((digest == last["_digest"]) & (F.col(ID) <= last["_id"])))


def power_limits(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """The first and 99th percentile of power over all rows of a site."""
    return exact_quantiles(df, POWER, {"p01": 0.01, "p99": 0.99}, keys).drop("n")


def spikes(df: DataFrame, keys=(SITE,)) -> DataFrame:
    limits = power_limits(df, keys).drop("p01")
    return attach(df, limits, keys).where(F.col(POWER) > F.col("p99"))


def dropouts(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Power under the first percentile between 8:00 and 22:59."""
    limits = power_limits(df, keys).drop("p99")
    return attach(df, limits, keys).where((F.col(POWER) < F.col("p01")) & F.hour(TS).between(8, 22))


def sample_span(df: DataFrame, skip_days: int = 30, days: int = 7, keys=(SITE,)) -> DataFrame:
    """``days`` of readings, both ends included, that start ``skip_days`` after the first."""
    first = df.groupBy(*keys).agg(F.min(TS).alias("_first"))
    since = micros(TS) - micros("_first")
    day = DAY_SECONDS * 1_000_000
    wanted = since.between(F.lit(skip_days * day), F.lit((skip_days + days) * day))
    return attach(df, first, keys).where(wanted).drop("_first")


def sample_week(df: DataFrame, skip_days: int = 30, keys=(SITE,)) -> DataFrame:
    """One week of power with a flag for readings above the site's 99th percentile."""
    week = sample_span(df, skip_days, 7, keys)
    limits = power_limits(df, keys).drop("p01")
    return attach(week, limits, keys).withColumn("is_spike", F.col(POWER) > F.col("p99"))


def rows_between(df: DataFrame, first: int, last: int, keys=(SITE,), order=tuple(ORDER)) -> DataFrame:
    """Rows at 0-based positions first..last-1 of each site."""
    numbered = number_rows(df, keys, order)
    return numbered.where((F.col("rn") > first) & (F.col("rn") <= last))


