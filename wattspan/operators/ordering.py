"""Row order of a site without putting a site into one task.

One site may hold a third of all rows, so nothing here sorts or windows over a
whole site. Rows are numbered inside short time slots, and the slots (a table
as long as the history, not as the data) carry the running offsets. Row-based
windows then run on chunks of consecutive row numbers, each with a copy of the
rows just before it.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.functions.clock import floor_to
from wattspan.schema import ORDER, SITE

SLOT_SECONDS = 3600
CHUNK_ROWS = 7_200
PIECE_ROWS = 50_000


def slot_starts(df: DataFrame, keys, slot: str) -> DataFrame:
    """Rows per slot, rows before it and rows from it to the end of the site."""
    counts = df.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("_in_slot"))
    ahead = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col(slot).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns(
        {
            "_before": F.coalesce(F.sum("_in_slot").over(ahead), F.lit(0)),
            "_after": F.coalesce(F.sum("_in_slot").over(behind), F.lit(0)),
        }
    )


def with_slot(df: DataFrame, order=ORDER, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    return df.withColumn("_slot", floor_to(order[0], slot_seconds * 1_000_000))


def number_rows(
    df: DataFrame,
    keys=(SITE,),
    order=tuple(ORDER),
    slot_seconds: int = SLOT_SECONDS,
    name: str = "rn",
) -> DataFrame:
    """Add the 1-based position of each row within its key, in ``order``.

    ``slot_seconds`` is the unit of work: a slot's rows are sorted in one task
    (spilling if need be). Lower it for meters that report many times a second.
    """
    keys = list(keys)
    slotted = with_slot(df, order, slot_seconds)
    starts = slot_starts(slotted, keys, "_slot").select(*keys, "_slot", "_before")
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(*order)
    return (
        slotted.join(starts, [*keys, "_slot"])
        .withColumn(name, F.col("_before") + F.row_number().over(in_slot))
        .drop("_slot", "_before")
    )


def in_pieces(df: DataFrame, keys, order, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows in pieces of about ``piece_rows``, with ``_piece``: pieces follow each other in the order
    of (keys, ``order``), whatever the values are. The cuts come from Spark's sample of the rows;
    ``_tie`` tells rows apart that are equal in all of this, so that they can be cut as well.
    The pieces are written, since a second sample could cut elsewhere."""
    held = durable(df, "rows")
    held = held.withColumn("_tie", F.monotonically_increasing_id())
    count = max(1, math.ceil(held.count() / piece_rows))
    cut = held.repartitionByRange(count, *keys, *order, "_tie") if count > 1 else held.coalesce(1)
    return durable(cut.withColumn("_piece", F.spark_partition_id()), "pieces")


def rank_rows(df: DataFrame, keys=(SITE,), order=tuple(ORDER), name: str = "rn", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Like :func:`number_rows` for any order and any spread of its values: neither time slots nor value
    cells nor evenly spread ids are needed. Rows are ranked in pieces, and a table with a row per key and piece
    carries the counts of the pieces before. Rows that are equal in ``order`` are ranked in no certain order."""
    keys = list(keys)
    pieces = in_pieces(df, keys, order, piece_rows)
    ahead = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, "_piece", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order, "_tie")
    ranked = pieces.join(durable(counts, "counts"), [*keys, "_piece"])
    return ranked.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_piece", "_before", "_tie")


def last_rows(df: DataFrame, n: int, keys=(SITE,), order=tuple(ORDER), slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """The last ``n`` rows of each key; only slots that can hold them are sorted."""
    keys = list(keys)
    slotted = with_slot(df, order, slot_seconds)
    tail = slot_starts(slotted, keys, "_slot").where(F.col("_after") < n).select(*keys, "_slot", "_after")
    newest = Window.partitionBy(*keys, "_slot").orderBy(*[F.col(c).desc() for c in order])
    return (
        slotted.join(tail, [*keys, "_slot"])
        .withColumn("_pos", F.col("_after") + F.row_number().over(newest))
        .where(F.col("_pos") <= n)
        .drop("_slot", "_after", "_pos")
    )


def with_halo(df: DataFrame, halo: int, rn: str = "rn", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cut numbered rows into chunks and copy each chunk's last ``halo`` rows to the next.

    Adds ``_chunk`` and ``_copied``; a row-based window that looks back at most
    ``halo`` rows and is partitioned by key and ``_chunk`` is exact on the rows
    that are not copies.
    """
    size = max(chunk_rows, halo, 1)
    own = F.floor((F.col(rn) - 1) / F.lit(size))
    at = F.pmod(F.col(rn) - 1, F.lit(size))
    targets = F.when(at >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("_own", own)
        .withColumn("_chunk", F.explode(targets))
        .withColumn("_copied", F.col("_chunk") != F.col("_own"))
        .drop("_own")
    )


def chunk_window(keys=(SITE,), rn: str = "rn"):
    return Window.partitionBy(*keys, "_chunk").orderBy(rn)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_copied")).drop("_chunk", "_copied")
