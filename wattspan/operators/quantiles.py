"""Exact, linearly interpolated quantiles by radix passes that only count, and stored sketches for any range.

A pass deals the values into cells by a digit that never falls as the value grows: first by sign and
magnitude, then by their place between the smallest and the largest value of a cell. Of a cell only its count, smallest and
largest value leave a task, at most ``DIGITS`` cells for each wanted rank; the next
pass looks into the cells that hold a wanted rank and still have two different values. No values are sorted, shuffled
or gathered, and a cell becomes some thousand times narrower by each pass, so that seven
passes tell any two doubles apart and measurements with a few decimals need two or three.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.schema import SITE, TS

#: cells of a cell in one pass, and magnitudes per power of two in the first
DIGITS, STEPS = 4096, 8


def attach(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Add the columns of a per-key table; with no keys ``stats`` is a single row.

    The table is written first: its size is known then, and the planner broadcasts it by its
    own check instead of shuffling all rows by a key that may hold a third of them.
    """
    if keys:
        return df.join(durable(stats, "stats"), list(keys))
    row = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumns({c: row.getField(c) for c in stats.columns})


def _ranks(probabilities, total: Column) -> list[tuple[Column, Column, Column]]:
    out = []
    for p in probabilities:
        at = F.lit(float(p)) * (total - 1)
        low = F.floor(at)
        out.append((low, F.ceil(at), at - low))
    return out


def _magnitude(v: Column) -> Column:
    """The first digit: zero for zero, else the sign with the place of the magnitude above that of the smallest double."""
    place = F.least(F.floor(F.log2(F.abs(v)) * STEPS), F.lit(1025 * STEPS)) + 1080 * STEPS
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * place).cast("long")


def _dealt(values: DataFrame, by: list[str], digit: Column) -> DataFrame:
    """Count, smallest and largest value per digit."""
    return values.groupBy(*by, digit.alias("_digit")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )


def _hit(cells: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """The cells that hold a wanted rank, with the number of values before them."""
    order = Window.partitionBy(*by).orderBy("_digit")
    start = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", F.col("_start") + start)
    held = F.filter("_wanted", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    cells = cells.withColumn("_held", held).where(F.size("_held") > 0)
    return cells.select(*keys, "_low", "_high", "_before", F.col("_held").alias("_wanted"), "_total")


def exact_quantiles(df: DataFrame, value, probabilities: dict[str, float], keys=()) -> DataFrame:
    """One row per key: the named quantiles and ``n``, the count of values that are neither null nor NaN."""
    keys = list(keys)
    column = F.col(value) if isinstance(value, str) else value
    values = df.select(*keys, (column.cast("double") + 0.0).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    values = durable(values, "values")  # read once per pass
    cells = _dealt(values, keys, _magnitude(F.col("_v")))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranks = _ranks(probabilities.values(), F.col("_total"))
    wanted = F.array_distinct(F.array(*[r for low, high, _ in ranks for r in (low, high)]))
    cells = cells.withColumn("_total", total).withColumns({"_wanted": wanted, "_start": F.lit(0)})
    hit = durable(_hit(cells, keys, keys), "cells")
    done = hit.where("_low = _high")
    while not (going := hit.where("_low < _high")).isEmpty():
        # a few cells per key: two for each wanted quantile at most
        bounds = going.groupBy(*keys).agg(F.collect_list(F.struct("_low", "_high")).alias("_cells"))
        inside = attach(values, bounds, keys)
        own = F.get(F.filter("_cells", lambda c: (c["_low"] <= F.col("_v")) & (F.col("_v") <= c["_high"])), F.lit(0))
        inside = inside.select(*keys, "_v", own.alias("_own")).where("_own IS NOT NULL")
        inside = inside.select(*keys, "_v", F.col("_own._low").alias("_cell"), F.col("_own._high").alias("_top"))
        # two doubles of one magnitude: their difference is finite, and not zero unless they are equal
        share = (F.col("_v") - F.col("_cell")) / (F.col("_top") - F.col("_cell"))
        digit = F.least(F.floor(share * DIGITS), F.lit(DIGITS - 1))
        cells = _dealt(inside, [*keys, "_cell"], digit)
        start = going.select(*keys, F.col("_low").alias("_cell"), F.col("_before").alias("_start"), "_wanted", "_total")
        hit = durable(_hit(cells.join(start, [*keys, "_cell"]), [*keys, "_cell"], keys), "cells")
        done = done.union(hit.where("_low = _high"))
    found = done.select(*keys, "_total", F.col("_low").alias("_v"), F.explode("_wanted").alias("_rank"))
    picked = []
    for name, (low, high, share) in zip(probabilities, ranks):
        at_low = F.max(F.when(F.col("_rank") == low, F.col("_v")))
        at_high = F.max(F.when(F.col("_rank") == high, F.col("_v")))
        between = F.when(at_low == at_high, at_low).otherwise(at_low + (at_high - at_low) * F.max(share))
        picked.append(between.alias(name))
    return found.groupBy(*keys).agg(*picked, F.max("_total").alias("n"))


def daily_sketches(df: DataFrame, value, keys=(SITE,), k: int = 800) -> DataFrame:
    """A KLL sketch of the values of every key and day: (keys, day, sketch, n). Null and NaN are left out.

    The table is what a range of days needs: sketches merge, and readings are not read again. ``k`` sets the
    error: see :func:`rank_error`.
    """
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, F.to_date(TS).alias("day"), column.cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*keys, "day").agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def rank_error(k: int = 800) -> float:
    """How far the rank of a sketched quantile may be off, as a share of all values: 2.296 / k ** 0.9021, the bound that
    the sketch's authors give for one quantile with 99 % confidence."""
    return 2.296 / k**0.9021


def sketched_quantiles(sketches: DataFrame, probabilities: dict[str, float], start=None, end=None, keys=(SITE,), k: int = 800) -> DataFrame:
    """The named quantiles of each key over the days from ``start`` to ``end`` (inclusive; open if None), from
    stored sketches alone, and ``n``. A quantile is one of the values."""
    if start is not None:
        sketches = sketches.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        sketches = sketches.where(F.col("day") <= F.lit(end).cast("date"))
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("_s"), F.sum("n").alias("n"))
    marks = [F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(name) for name, p in probabilities.items()]
    return merged.select(*keys, *marks, "n")
