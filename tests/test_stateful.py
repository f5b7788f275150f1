"""Scores from keyed state equal those of one batch, through restarts, for busy and idle sites."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattspan.models.scoring import AnomalyDetector
from wattspan.plans import training
from wattspan.sources import synthetic
from wattspan.streaming import live, stateful

FRAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = synthetic.generate_dataset(spark, 3, datetime(2024, 1, 1)).withColumnRenamed("seq", "id").drop("injected")
    rows = rows.withColumns({"site_id": F.lit("home-01"), "device_id": F.lit("m")}).cache()
    models = str(tmp_path_factory.mktemp("models") / "m")
    training.train_models(rows, models, trees=10)
    return rows, AnomalyDetector(spark, models)


def run(spark, folder, detector, **options):
    paths = [str(folder / n) for n in ("out", "late", "progress")]
    stream = live.read_reading_stream(spark, str(folder / "in"), 1)
    query = stateful.score_stateful(stream, detector, *paths, **options)
    query.awaitTermination()
    return query


def tail_of(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "tail").load(str(folder / "progress"))


def test_scores_equal_batch_scores_after_restarts(spark, made, tmp_path):
    rows, detector = made
    spark.conf.set(FRAME, 100)  # a site's rows come in many frames
    both = rows.unionByName(rows.where("id < 2000").withColumn("site_id", F.lit(None).cast("string")))
    for low, high in ((0, 1500), (1500, 2900), (2900, 4320)):
        part = both.where((F.col("id") >= low) & (F.col("id") < high))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path, detector)  # ends and starts anew from its checkpoint
    want = detector.score_raw_readings(both).select("site_id", "id", "anomaly_score")
    got = spark.read.parquet(str(tmp_path / "out")).select("site_id", "id", F.col("anomaly_score").alias("live"))
    same = [F.coalesce("site_id", F.lit("-")).alias("site_id"), "id"]
    met = want.select(*same, "anomaly_score").join(got.select(*same, "live"), ["site_id", "id"], "full")
    assert met.where("live is null or anomaly_score is null or abs(live - anomaly_score) > 1e-9").count() == 0
    assert met.count() == want.count() == got.count() > 3500
    assert spark.conf.get(stateful.PROVIDER) != stateful.ROCKS
    spark.conf.unset(FRAME)


def test_idle_sites_cost_nothing_and_late_rows_are_set_aside(spark, made, tmp_path):
    rows, detector = made
    others = rows.where("id < 30").withColumn("site_id", F.concat(F.lit("idle-"), (F.col("id") % 10).cast("string")))
    first = rows.where("id < 2000").unionByName(others)
    first.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, tmp_path, detector)
    second = rows.where("id >= 2000 and id < 2200 or id = 7")
    second.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = run(spark, tmp_path, detector)
    told = [p for p in query.recentProgress if p["numInputRows"]][-1]["stateOperators"][0]
    assert told["numRowsUpdated"] == live.LOOK_BACK_ROWS  # the entries of one site; the thirty of ten idle ones are not written
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [7]
    assert spark.read.parquet(str(tmp_path / "out")).where("id = 7 or id < 719").count() == 0
    with stateful.rocks_state(spark):
        held = {r["site_id"]: r["count"] for r in tail_of(spark, tmp_path).groupBy("key.site_id").count().collect()}
    assert held["home-01"] == live.LOOK_BACK_ROWS and held["idle-3"] == 3 and len(held) == 11


def test_rows_come_out_as_they_went_in(spark, made, tmp_path):
    """Nulls, NaN, ids beyond 2^53 and repeated rows."""
    rows, _ = made
    odd = rows.where("id < 4").withColumns(
        {
            "id": F.when(F.col("id") == 0, 2**60 + 1).when(F.col("id") == 1, None).otherwise(F.col("id")),
            "timestamp": F.when(F.col("id") != 3, F.col("timestamp")),
            "voltage_v": F.when(F.col("id") == 0, F.lit(float("nan"))).when(F.col("id") == 1, None).otherwise(0.1),
        }
    )
    odd = odd.unionByName(odd).cache()
    odd.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.handed_on(live.read_reading_stream(spark, str(tmp_path / "in")))
    out = str(tmp_path / "out")
    with stateful.rocks_state(spark):
        live._start(stream.writeStream.format("parquet").option("path", out), str(tmp_path / "progress"), None).awaitTermination()
    got = stateful.unpacked(spark.read.parquet(out))
    columns = [c for c in got.columns if c != "state"]
    assert got.where("state != 'new'").count() == 0 and got.count() == 8
    assert got.select(columns).exceptAll(odd.select(columns)).count() == 0


def test_idle_sites_are_forgotten_on_the_clock(spark, made, tmp_path):
    rows, detector = made
    (tmp_path / "in").mkdir()
    stream = live.read_reading_stream(spark, str(tmp_path / "in"), 1)
    paths = [str(tmp_path / n) for n in ("out", "late", "progress")]
    with pytest.raises(ValueError):
        stateful.score_stateful(stream, detector, *paths, forget_after_ms=1)
    rows.where("id < 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    handed = stateful.handed_on(stream, 1_000)
    seen = []

    def note(batch, number):
        seen.extend(r["state"] for r in batch.select("state").distinct().collect())
        if number == 0:
            time.sleep(2)
            rows.where("id = 7").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    with stateful.rocks_state(spark):
        query = live._start(handed.writeStream.foreachBatch(note), paths[2], "1 second")
    end = time.time() + 40
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.5)
    query.stop()
    assert seen == ["new", "new"]  # the site came back as a new one: no tail, nothing late


def test_rows_of_one_site_are_dealt_out(spark, made, tmp_path):
    """No key gets all rows of a site; look-backs and late rows are those of one pass over the site."""
    rows, detector = made
    spark.conf.set(FRAME, 500)
    for low, high in ((0, 2500), (2400, 4320)):  # the second arrival has a hundred late rows
        part = rows.where((F.col("id") >= low) & (F.col("id") < high))
        part.orderBy(F.rand(2)).repartition(3).write.mode("append").parquet(str(tmp_path / f"in-{low}"))
    seen, tails = [], []

    def note(batch, number):
        held = batch.withColumn("task", F.spark_partition_id()).cache()
        told = stateful.with_late(held.drop("task"))
        seen.append({r["state"]: r["count"] for r in told.groupBy("state").count().collect()})
        tails.append({r["no"] for r in held.where("state = 'tail'").collect()})
        by_task = [r["count"] for r in held.where("state = 'new'").groupBy("task").count().collect()]
        assert len(by_task) > 4 and max(by_task) < 0.5 * sum(by_task)

    for low in (0, 2400):
        source = str(tmp_path / "in")
        spark.read.parquet(str(tmp_path / f"in-{low}")).write.mode("append").parquet(source)
        stream = stateful.handed_on(live.read_reading_stream(spark, source))
        with stateful.rocks_state(spark):
            live._start(stream.writeStream.foreachBatch(note), str(tmp_path / "progress"), None).awaitTermination()
    spark.conf.unset(FRAME)
    assert seen == [{"new": 2500}, {"tail": 1439, "new": 1821, "late": 99}]
    assert tails == [set(), set(range(2500 - 1439, 2500))]
