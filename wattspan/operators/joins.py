"""Overlay of scores on readings and marking of the nearest bucket or target."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.functions.clock import from_micros, micros, rule_micros
from wattspan.operators.ordering import PIECE_ROWS, in_pieces
from wattspan.operators.quantiles import attach
from wattspan.schema import ORDER, SITE, TS

SCORE_COLUMNS = ["anomaly_score", "is_anomaly"]


def overlay(readings: DataFrame, scored: DataFrame, keys=(SITE,), order=tuple(ORDER)) -> DataFrame:
    """Every reading with its score; the id in the key keeps equal timestamps apart."""
    on = [*keys, *order]
    return readings.join(scored.select(*on, *SCORE_COLUMNS), on, "left")


def nearest_buckets(events: DataFrame, buckets: DataFrame, rule: str, keys=(SITE,)) -> DataFrame:
    """Buckets nearest to at least one event; a tie goes to the later bucket.

    Buckets are regular, so the nearest start is arithmetic and the join is an
    equality. Events beyond the ends fall to the first or last bucket.
    """
    step = rule_micros(rule)
    ends = buckets.groupBy(*keys).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    since = micros(TS) - micros("_a")
    steps = F.floor((since + step // 2) / F.lit(step))
    last = F.floor((micros("_b") - micros("_a")) / F.lit(step))
    clamped = F.least(F.greatest(steps, F.lit(0)), last)
    hit = (
        attach(events.select(*keys, TS), ends, keys)
        .select(*keys, from_micros(micros("_a") + clamped * step).alias("bucket"))
        .distinct()
    )
    return buckets.join(hit, [*keys, "bucket"], "left_semi")


def nearest_targets(events: DataFrame, targets: DataFrame, keys=(SITE,), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Every event with ``nearest``, the time of the nearest target of its key; a tie goes to the later one.

    Targets may lie at any times. Events and targets are read together in time order, in pieces of
    about ``piece_rows`` rows, so a key with a third of all rows is many pieces. A table with a row per key
    and piece carries the last target before and the first one after each. Events of a key without
    targets have null, as have those without a time; a null key has no row. Repeated targets count once.
    """
    keys = list(keys)
    marks = targets.select(*keys, F.col(TS).alias("_target")).where("_target IS NOT NULL").distinct()
    rows = events.withColumn("_at", F.col(TS)).unionByName(marks.withColumn("_at", F.col("_target")), allowMissingColumns=True)
    rows = in_pieces(rows, keys, ["_at"], piece_rows)
    ends = rows.groupBy(*keys, "_piece").agg(F.min("_target").alias("_a"), F.max("_target").alias("_b"))
    until = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *keys, "_piece", F.max("_b").over(until("_piece")).alias("_before"), F.min("_a").over(until(F.desc("_piece"))).alias("_after")
    )
    within = lambda order: (
        Window.partitionBy(*keys, "_piece").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.join(durable(ends, "ends"), [*keys, "_piece"]).withColumns(
        {
            "_before": F.greatest("_before", F.max("_target").over(within("_at"))),
            "_after": F.least("_after", F.min("_target").over(within(F.desc("_at")))),
        }
    )
    later = micros("_after") - micros("_at") <= micros("_at") - micros("_before")
    nearest = F.when(F.col("_before").isNull() | later, F.col("_after")).otherwise(F.col("_before"))
    nearest = F.when(F.col("_at").isNotNull(), F.coalesce(nearest, F.col("_before")))
    return rows.where("_target IS NULL").select(*events.columns, nearest.alias("nearest"))
