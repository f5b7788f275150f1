"""Streams give what the batch jobs give."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattspan.models.scoring import AnomalyDetector
from wattspan.operators import resample
from wattspan.plans import training
from wattspan.sources import fixtures, raw_lines, synthetic
from wattspan.sources.readings import read_readings
from wattspan.streaming import live


def test_ingest_equals_bulk_and_restarts_without_copies(spark, readings, tmp_path):
    raw, table, progress = (str(tmp_path / n) for n in ("raw", "table", "progress"))
    fixtures.raw_lines(readings).select("value").repartition(3).write.text(raw)
    for _ in range(2):
        live.ingest_stream(live.read_line_stream(spark, raw, 1), table, progress).awaitTermination()
    got = read_readings(spark, table).select("timestamp", "voltage_v")
    want = raw_lines.to_readings(raw_lines.validate_lines(fixtures.raw_lines(readings))).select("timestamp", "voltage_v")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("limit,expected", [(4, 4), (6, 3)])
def test_ingest_stops_at_max_rows(spark, tmp_path, limit, expected):
    good = "03/05/2019;06:10:00;0.812;0.064;229.310;3.600;0.000;0.000;6.000"
    body = [good] * 7 if expected == 4 else [good, "03/05/2019;6:11:00;?;?;?;?;?;?;?", good, "no meter line", good]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("\n".join(body) + "\n")
    table = str(tmp_path / "table")
    lines = live.read_line_stream(spark, str(tmp_path / "raw"))
    live.ingest_stream(lines, table, str(tmp_path / "progress"), max_rows=limit).awaitTermination()
    assert read_readings(spark, table).count() == expected


def test_replay(spark, tmp_path):
    table = str(tmp_path / "table")
    query = live.replay_stream(spark, table, str(tmp_path / "progress"), datetime(2024, 1, 1), 50, max_rows=40)
    deadline = time.time() + 40
    while read_readings(spark, table).count() < 40 and time.time() < deadline:
        time.sleep(1)
    query.stop()
    stored = read_readings(spark, table)
    assert stored.count() == 40
    batch = synthetic.generate_dataset(spark, 1, datetime(2024, 1, 1)).where("seq < 40")
    assert stored.select("timestamp", "voltage_v").exceptAll(batch.select("timestamp", "voltage_v")).count() == 0


def test_scores_equal_batch_scores(spark, tmp_path):
    rows = synthetic.generate_dataset(spark, 3, datetime(2024, 1, 1)).withColumnRenamed("seq", "id").drop("injected")
    rows = rows.withColumns({"site_id": F.lit("home-01"), "device_id": F.lit("m")}).cache()
    models, arrivals = str(tmp_path / "models"), str(tmp_path / "arrivals")
    training.train_models(rows, models, trees=20)
    detector = AnomalyDetector(spark, models)
    for low, high in ((0, 1500), (1500, 2900), (2900, 4320)):
        rows.where((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.mode("append").parquet(arrivals)
    out = str(tmp_path / "scores")
    stream = live.read_reading_stream(spark, arrivals, 1)
    live.score_stream(stream, detector, out, str(tmp_path / "tail"), str(tmp_path / "progress")).awaitTermination()
    want = detector.score_raw_readings(rows).select("id", "anomaly_score")
    got = spark.read.parquet(out).select("id", F.col("anomaly_score").alias("live"))
    both = want.join(got, "id", "full")
    assert both.where("live is null or anomaly_score is null or abs(live - anomaly_score) > 1e-9").count() == 0
    # 719 rows of warm-up and the rows without power (no metered ratio) have no score
    no_score = rows.where((F.col("id") < 719) | (F.col("global_active_power_kw") == 0)).count()
    assert 3500 < both.count() == want.count() <= 4320 - no_score + 5


def test_appended_buckets_are_written_once(spark, readings, tmp_path):
    arrivals, out, progress = (str(tmp_path / n) for n in ("arrivals", "out", "progress"))
    cuts = ["2023-01-01", "2024-01-08", "2024-01-17", "2030-01-01"]
    want = {}
    for low, high in zip(cuts, cuts[1:]):
        part = readings.where((F.col("timestamp") >= low) & (F.col("timestamp") < high))
        part.withColumn("ingested_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(arrivals)
        # the stream ends and starts anew from its checkpoint
        live.append_resampled(live.read_reading_stream(spark, arrivals, 1), "1h", out, progress).awaitTermination()
        live.close_resampled(spark, out, progress)
        got = live.read_appended(spark, out)
        want = resample.resample_mean(readings.where(F.col("timestamp") < high), "1h")
        told = lambda df: sorted((r["site_id"], r["bucket"]) for r in df.where("voltage_v IS NOT NULL").collect())
        assert told(got) == told(want)
    near = got.join(want.select("site_id", "bucket", F.col("voltage_v").alias("v")), ["site_id", "bucket"])
    assert near.where("abs(voltage_v - v) < 1e-9").count() == got.count()
    assert "batch=" not in got._jdf.queryExecution().toString()
