"""Live scoring with the look-back of every site in a state store.

The state of a site is what its next readings look back on: order and power of its last
1,439 rows. A micro-batch loads and writes the state of its own sites only; sites
without new rows cost nothing. All that a site's state needs of a task's new rows is the last 1,439 of them: only
these go to the site's key, in a short form. The rows themselves pass the stateful step under ``PARTS`` keys that hold
no state, dealt out by a hash, so no task has all rows of a site. Which of them are late follows from the look-back that
was handed out; features and scores are then computed by :meth:`AnomalyDetector.score_raw_readings`, which splits large
sites over tasks.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wattspan.durable import remove, scratch_path
from wattspan.functions.clock import from_micros, micros
from wattspan.models.scoring import AnomalyDetector
from wattspan.schema import ID, METRICS, ORDER, POWER, SITE, TS
from wattspan.streaming.live import LOOK_BACK_ROWS, _start

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# a null time or id is the smallest, as in an ascending order of Spark
LEAST = -(2**63)
SLIM = ["at", "no", "power"]
#: tasks that a micro-batch is packed by, however few its files are, keys that its rows are dealt out to, and rows of
#: look-backs that a task holds
PACKERS, PARTS, HELD = 32, 256, 100_000
PACKED = f"{SITE} string, part int, own string, at long, no long, power string, row string"
HANDED_ON = f"{SITE} string, at long, no long, power string, row string, state string"


def with_last(rows: int):
    """The rows that go by, and for part 0 of each site the last ones of them, without the ``row``."""

    def last_of(frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames).sort_values(["at", "no"], kind="stable").groupby("own", dropna=False).tail(rows)

    def packed(last: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(last.assign(**{SITE: last["own"], "part": 0, "row": None}), schema, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            yield batch
            schema = batch.schema
            held = [last_of([*held, batch.select(["own", *SLIM]).to_pandas()])]
            if len(held[0]) > HELD:
                yield packed(held.pop(), schema)
        if held:
            yield packed(held.pop(), schema)

    return run


class LookBack(StatefulProcessor):
    """Passes rows on as ``new``; for a site, hands out its look-back as ``tail`` and keeps that of the next rows."""

    def __init__(self, rows: int, forget_after_ms: int | None):
        self.rows, self.forget_after_ms = rows, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "at long, no long, power string", self.forget_after_ms)

    def handleInputRows(self, key, rows, timerValues):
        columns = [SITE, *SLIM, "row", "state"]
        if key[1]:
            for frame in rows:
                yield frame.assign(**{SITE: frame["own"], "state": "new"})[columns]
            return
        tail = pd.DataFrame(list(self.tail.get()), columns=SLIM)
        newest = tuple(int(x) for x in tail.iloc[-1][["at", "no"]]) if len(tail) else None
        if len(tail):
            yield tail.assign(**{SITE: key[0], "row": None, "state": "tail"})[columns]
        for frame in rows:
            late = pd.Series(False, frame.index)
            if newest:
                late = (frame["at"] < newest[0]) | ((frame["at"] == newest[0]) & (frame["no"] < newest[1]))
            tail = pd.concat([tail, frame.loc[~late, SLIM]]) if len(tail) else frame.loc[~late, SLIM]
            tail = tail.sort_values(["at", "no"], kind="stable").iloc[-self.rows :]
        if len(tail):
            powers = [p if isinstance(p, str) else None for p in tail["power"]]
            self.tail.put(list(zip(tail["at"].tolist(), tail["no"].tolist(), powers, strict=True)))

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which the processor needs; the setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def handed_on(readings: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """The rows of a stream, as ``new``, and the rows that those of each site look back on.

    A reading travels as text, so that nulls, NaN and large ids come out as they went in."""
    columns = [ID, TS, *METRICS]
    least = F.lit(LEAST)
    packed = readings.select(SITE, *columns).repartition(PACKERS, SITE, *columns).select(
        F.lit(None).cast("string").alias(SITE),
        (F.pmod(F.xxhash64(SITE, *columns), F.lit(PARTS)) + 1).cast("int").alias("part"),
        F.col(SITE).alias("own"),
        F.coalesce(micros(TS), least).alias("at"),
        F.coalesce(F.col(ID), least).alias("no"),
        F.col(POWER).cast("string").alias("power"),
        F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns])).alias("row"),
    )
    mode = "None" if forget_after_ms is None else "ProcessingTime"
    packed = packed.mapInArrow(with_last(LOOK_BACK_ROWS), PACKED)
    return packed.groupBy(SITE, "part").transformWithStateInPandas(LookBack(LOOK_BACK_ROWS, forget_after_ms), HANDED_ON, "Append", mode)


def with_late(rows: DataFrame) -> DataFrame:
    """The rows of :func:`handed_on` of one micro-batch, with new ones that are older than the look-back's newest as ``late``."""
    newest = rows.where("state = 'tail'").groupBy(F.col(SITE).alias("_site")).agg(F.max(F.struct("at", "no")).alias("_newest"))
    rows = rows.join(F.broadcast(newest), F.col(SITE).eqNullSafe(F.col("_site")), "left")  # a row per site
    is_late = (F.col("state") == "new") & (F.struct("at", "no") < F.col("_newest"))
    return rows.withColumn("state", F.when(is_late, "late").otherwise(F.col("state"))).drop("_site", "_newest")


def unpacked(rows: DataFrame) -> DataFrame:
    """The readings of :func:`handed_on`, with their ``state``; a look-back row has no metric but the power."""
    columns = [ID, TS, *METRICS]
    kinds = dict.fromkeys(METRICS, "double") | {ID: "bigint", TS: "timestamp_ntz"}
    told = F.from_json("row", ", ".join(f"{c} string" for c in columns))
    own = {
        ID: F.nullif("no", F.lit(LEAST)),
        TS: from_micros(F.nullif("at", F.lit(LEAST))),
        POWER: F.col("power").cast("double"),
    }
    rows = rows.withColumn("_told", told)
    return rows.select(
        SITE,
        "state",
        *[F.when(F.col("state") != "tail", F.col(f"_told.{c}").cast(kinds[c])).otherwise(own.get(c)).alias(c) for c in columns],
    )


def score_stateful(
    readings: DataFrame,
    detector: AnomalyDetector,
    out_path: str,
    late_path: str,
    checkpoint: str,
    forget_after_ms: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Score the readings of each micro-batch with the rows that came before them.

    Like :func:`wattspan.streaming.live.score_stream`, but the look-back is keyed state: a restart goes
    on from the checkpoint, and the cost of a micro-batch depends on its own rows and sites. A reading older than
    the newest one of an earlier batch is not scored but written to ``late_path``. With ``forget_after_ms``
    the state of a site without rows for that long is dropped; the site then starts as a new one. Spark runs such a
    stream on the clock, so that it never has all of what is there: it needs an ``interval``.
    Rows without a site are one site; a time or id that is null comes first; repeated rows are kept.
    A site's key is sent at most 1,439 rows by each task, or one more time for every ``HELD`` rows of look-backs that a
    task has met; all else is spread over tasks.
    """
    spark = readings.sparkSession
    if forget_after_ms is not None and interval is None:
        raise ValueError("forget_after_ms needs an interval")

    def score(batch: DataFrame, number: int) -> None:
        # the stateful step runs once: its rows are read twice
        path = scratch_path(spark, "handed-on")
        batch.write.parquet(path)
        rows = unpacked(with_late(spark.read.schema(HANDED_ON).parquet(path)))
        rows.where("state = 'late'").drop("state").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        fresh = rows.where("state != 'late'").withColumn("_new", F.col("state") == "new").drop("state")
        scored = detector.score_raw_readings(fresh).where("_new")
        result = scored.select(SITE, *ORDER, POWER, "anomaly_score", "is_anomaly")
        result.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        remove(spark, path)

    with rocks_state(spark):
        return _start(handed_on(readings, forget_after_ms).writeStream.foreachBatch(score), checkpoint, interval)
