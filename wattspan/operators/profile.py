"""Statistics of readings and feature matrices, per site unless other keys are given."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.durable import durable
from wattspan.functions.calendar import CYCLICAL, calendar_parts, cyclical
from wattspan.functions.clock import DAY_US, micros
from wattspan.functions.energy import half_up, unmetered_wh
from wattspan.operators.quantiles import attach, exact_quantiles
from wattspan.operators.resample import daily_counts
from wattspan.schema import CURRENT, ID, METRICS, POWER, SITE, SUB_METERS, TS, VOLTAGE

READINGS_PER_DAY = 1440
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def long_form(df: DataFrame, columns, keys=(SITE,), name: str = "metric", value: str = "value") -> DataFrame:
    """One row per key and column, as (metric, value)."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keys), list(columns), name, value)


def statistics(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Counts, power, voltage and current of a range; energy comes from the rounded mean."""
    raw = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("readings"),
        half_up(F.avg(POWER), 3).alias("avg_power"),
        half_up(F.max(POWER), 3).alias("max_power"),
        half_up(F.min(POWER), 3).alias("min_power"),
        half_up(F.avg(VOLTAGE), 1).alias("avg_voltage"),
        half_up(F.min(VOLTAGE), 1).alias("min_voltage"),
        half_up(F.max(VOLTAGE), 1).alias("max_voltage"),
        half_up(F.avg(CURRENT), 1).alias("avg_current"),
    )
    return raw.withColumn("estimated_total_kwh", half_up(F.col("avg_power") * F.col("readings") / 60, 2))


def date_range(df: DataFrame, keys=(SITE,)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(TS).alias("earliest"), F.max(TS).alias("latest"), F.count(F.lit(1)).alias("total_readings")
    )


def cards(df: DataFrame, scored: DataFrame | None = None, keys=(SITE,)) -> DataFrame:
    """Mean and peak power, readings and mean voltage, with the anomaly share when scored."""
    out = df.groupBy(*keys).agg(
        F.avg(POWER).alias("avg_power"),
        F.max(POWER).alias("peak_power"),
        F.count(F.lit(1)).alias("readings"),
        F.avg(VOLTAGE).alias("avg_voltage"),
    )
    if scored is None:
        return out
    found = scored.groupBy(*keys).agg(
        F.count_if("is_anomaly").alias("anomalies"),
        (F.count_if("is_anomaly") / F.count(F.lit(1)) * 100).alias("anomaly_pct"),
    )
    return out.join(found, list(keys), "left")


def describe(df: DataFrame, columns=tuple(METRICS), keys=(SITE,)) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each column."""
    values = long_form(df, columns, keys)
    by = [*keys, "metric"]
    basic = values.groupBy(*by).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basic.join(exact_quantiles(values, "value", QUARTILES, by).drop("n"), by, "left")


def shape(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Rows, columns, first and last reading and whole days between them."""
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema if f.name != ID)
    whole_days = F.floor((micros(F.max(TS)) - micros(F.min(TS))) / F.lit(DAY_US))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(numeric).cast("long").alias("numeric_columns"),
        F.min(TS).alias("first"),
        F.max(TS).alias("last"),
        whole_days.alias("days"),
    )


def null_counts(df: DataFrame, columns=tuple(METRICS), keys=(SITE,)) -> DataFrame:
    """Nulls per column, with their total and the number of rows."""
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    counted = counted.withColumn("total_nulls", total)
    return counted.unpivot([*keys, "rows", "total_nulls"], list(columns), "metric", "nulls")


def null_shares(features: DataFrame, columns, keys=(SITE,)) -> DataFrame:
    """Columns that have nulls, with their share in percent."""
    counted = null_counts(features, columns, keys).where(F.col("nulls") > 0)
    return counted.select(*keys, "metric", "nulls", half_up(F.col("nulls") * 100 / F.col("rows"), 2).alias("pct"))


def dropped_rows(features: DataFrame, columns, keys=(SITE,)) -> DataFrame:
    """Rows before and after dropping those with a null, counted in one pass."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    counted = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(whole).alias("rows_after"))
    dropped = F.col("rows_before") - F.col("rows_after")
    return counted.withColumn("dropped", dropped).withColumn(
        "dropped_pct", half_up(F.col("dropped") * 100 / F.col("rows_before"), 2)
    )


def hourly(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Mean, sample deviation, exact median and the mean-deviation band by hour of day."""
    by = [*keys, "hour"]
    hours = df.withColumn("hour", F.hour(TS)).select(*by, POWER)
    basic = hours.groupBy(*by).agg(F.avg(POWER).alias("mean_kw"), F.stddev_samp(POWER).alias("std_kw"))
    medians = exact_quantiles(hours, POWER, {"median_kw": 0.5}, by).drop("n")
    return basic.join(medians, by).withColumns(
        {"band_low": F.col("mean_kw") - F.col("std_kw"), "band_high": F.col("mean_kw") + F.col("std_kw")}
    )


def weekend_hours(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Mean power by hour, weekdays beside weekends."""
    parts = calendar_parts()
    tagged = df.select(*keys, parts["hour"].alias("hour"), parts["is_weekend"].alias("w"), POWER)
    side = tagged.groupBy(*keys, "hour").agg(
        F.avg(F.when(F.col("w") == 0, F.col(POWER))).alias("weekday_kw"),
        F.avg(F.when(F.col("w") == 1, F.col(POWER))).alias("weekend_kw"),
    )
    return side


def monthly_box(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Quartiles by month and the furthest values within 1.5 quartile ranges of them."""
    by = [*keys, "month"]
    months = df.withColumn("month", F.month(TS)).select(*by, POWER)
    box = exact_quantiles(months, POWER, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by).drop("n")
    box = durable(box, "box")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(POWER).between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = months.join(box, by).where(inside).groupBy(*by)
    return box.join(
        whiskers.agg(F.min(POWER).alias("whisker_low"), F.max(POWER).alias("whisker_high")), by
    )


def histogram(df: DataFrame, columns=tuple(METRICS), bins: int = 80, keys=(SITE,)) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; the last one is closed."""
    values = long_form(df, columns, keys).where(F.col("value").isNotNull())
    by = [*keys, "metric"]
    ends = values.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    low = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    high = F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    limits = ends.select(*by, low.alias("lo"), high.alias("hi"))
    # a row per key and column, written first so that the planner knows its size
    limits = durable(limits.withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(bins)), "ends")
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = values.join(limits, by).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def correlation_matrix(df: DataFrame, columns=tuple(METRICS), keys=(SITE,)) -> DataFrame:
    """The full Pearson matrix of a few columns in long form; a constant column has none."""
    pairs = list(combinations(columns, 2))

    # not F.corr: it divides by zero, an error in ANSI mode, where a column is constant
    def correlation(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))

    wide = df.groupBy(*keys).agg(*[correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cell = lambda a, b, c: F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), c.alias("correlation"))
    cells = [cell(c, c, F.lit(1.0)) for c in columns]
    for i, (a, b) in enumerate(pairs):
        cells += [cell(a, b, F.col(f"_{i}")), cell(b, a, F.col(f"_{i}"))]
    return wide.select(*keys, F.inline(F.array(*cells)))


HELD_KEYS = 256


def _co_moments(keys, columns):
    """Per task and key: size, means and centred products of every pair of columns.

    A task holds the sums of up to HELD_KEYS keys before it passes them on."""
    i, j = np.triu_indices(len(columns))

    def emit(held):
        for key, (n, mean, products) in held.items():
            yield pd.DataFrame({**dict(zip(keys, key)), "i": i, "j": j, "n": n, "m_i": mean[i], "m_j": mean[j], "c": products[i, j]})

    def moments(batches):
        held = {}
        for batch in batches:
            groups = batch.groupby(list(keys), sort=False) if keys else [((), batch)]
            for key, rows in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = rows[list(columns)].to_numpy(dtype=float)
                # constant columns get no rounding of their mean as spread
                mean = np.where(x.min(axis=0) == x.max(axis=0), x[0], x.mean(axis=0))
                centred = x - mean
                n, products = float(len(x)), centred.T @ centred
                if key in held:
                    before, far, old = held[key]
                    step = mean - far
                    products = old + products + np.outer(step, step) * (before * n / (before + n))
                    mean, n = np.where(step == 0, far, far + step * (n / (before + n))), before + n
                held[key] = (n, mean, products)
            if len(held) > HELD_KEYS:
                yield from emit(held)
                held = {}
        yield from emit(held)

    return moments


def pair_correlations(df: DataFrame, columns, keys=(SITE,)) -> DataFrame:
    """Pearson correlation of every pair of many columns without nulls, one row per pair.

    Hundreds of pair aggregates are too many for one plan, so each Arrow batch
    is reduced to the centred products of its columns, and these small rows are
    summed by (key, pair) with partial aggregation, first to the means of all rows
    and then to the products around them. Constant columns have no row.
    """
    columns, keys = list(columns), list(keys)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    schema = T.StructType([f for f in rows.schema if f.name in keys])
    for name in ("i", "j"):
        schema = schema.add(name, T.IntegerType())
    for name in ("n", "m_i", "m_j", "c"):
        schema = schema.add(name, T.DoubleType())
    parts = durable(rows.mapInPandas(_co_moments(keys, columns), schema), "moments")
    # what a batch's means are off the means of all rows is added centred, so nothing cancels
    on = [*keys, "i", "j"]

    def mean(m: str):
        # exact where all batches agree, so that a constant column has no spread at all
        return F.when(F.min(m) == F.max(m), F.min(m)).otherwise(F.sum(F.col("n") * F.col(m)) / F.sum("n"))

    whole = parts.groupBy(*on).agg(mean("m_i").alias("w_i"), mean("m_j").alias("w_j"))
    off = F.col("n") * (F.col("m_i") - F.col("w_i")) * (F.col("m_j") - F.col("w_j"))
    merged = parts.join(whole, on)
    products = merged.groupBy(*on).agg(F.sum(F.col("c") + off).alias("cov"))
    own = products.where((F.col("i") == F.col("j")) & (F.col("cov") > 0)).select(*keys, "i", F.col("cov").alias("var"))
    first = own.withColumnRenamed("var", "var_i")
    second = own.select(*keys, F.col("i").alias("j"), F.col("var").alias("var_j"))
    names = F.array(*[F.lit(c) for c in columns])
    return (
        products.where(F.col("i") < F.col("j"))
        .join(first, [*keys, "i"])
        .join(second, [*keys, "j"])
        .select(
            *keys,
            F.get(names, F.col("i")).alias("feature_1"),
            F.get(names, F.col("j")).alias("feature_2"),
            (F.col("cov") / F.sqrt(F.col("var_i") * F.col("var_j"))).alias("correlation"),
        )
    )


def strongest_correlations(df: DataFrame, columns, target: str = POWER, n: int = 20, keys=(SITE,)) -> DataFrame:
    """Per key, the ``n`` columns that correlate most with ``target``, by absolute value."""
    keys = list(keys)
    pairs = pair_correlations(df, columns, keys).where((F.col("feature_1") == target) | (F.col("feature_2") == target))
    other = F.when(F.col("feature_1") == target, F.col("feature_2")).otherwise(F.col("feature_1"))
    found = pairs.select(*keys, other.alias("feature"), F.abs("correlation").alias("abs_correlation"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    itself = groups.select(*keys, F.lit(target).alias("feature"), F.lit(1.0).alias("abs_correlation"))
    # a row per column and key
    best = Window.partitionBy(*keys).orderBy(F.col("abs_correlation").desc(), "feature")
    return found.unionByName(itself).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= n).drop("_rank")


def redundant_pairs(df: DataFrame, columns, limit: float = 0.95, keys=(SITE,)) -> DataFrame:
    """Pairs of columns whose absolute correlation is above ``limit``."""
    pairs = pair_correlations(df, columns, keys).withColumn("correlation", F.abs("correlation"))
    return pairs.where(F.col("correlation") > limit)


def energy_shares(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Mean Wh per minute of each sub-meter and of the rest, with its share of their sum."""
    names = [*SUB_METERS, "unmetered_wh"]
    wide = df.withColumn("unmetered_wh", unmetered_wh()).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    long = wide.withColumn("_total", total).unpivot([*keys, "_total"], names, "meter", "mean_wh")
    return long.select(*keys, "meter", "mean_wh", (F.col("mean_wh") / F.nullif("_total", F.lit(0.0)) * 100).alias("pct"))


def completeness(df: DataFrame, keys=(SITE,)) -> DataFrame:
    """Calendar days with fewer than a day's worth of minutes."""
    counted = daily_counts(df, keys).groupBy(*keys).agg(
        F.count_if(F.col("readings") < READINGS_PER_DAY).alias("incomplete_days"),
        F.count(F.lit(1)).alias("total_days"),
    )
    return counted.withColumn("incomplete_pct", F.col("incomplete_days") * 100 / F.col("total_days"))


def cycle_means(df: DataFrame, part: str = "hour", keys=(SITE,)) -> DataFrame:
    """Mean sine and cosine of the hour or weekday encoding, by hour or weekday."""
    parts = calendar_parts()
    name = {"hour": "hour", "day_of_week": "dow"}[part]
    encoded = cyclical(parts)
    chosen = [c for c in CYCLICAL if c.startswith(name + "_")]
    rows = df.select(*keys, parts[part].alias(part), *[encoded[c].alias(c) for c in chosen])
    return rows.groupBy(*keys, part).agg(*[F.avg(c).alias(c) for c in chosen])
