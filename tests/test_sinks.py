"""The readings table under several writers, and the edges of the reads that rest on it."""

import json
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattspan.functions.clock import rule_micros
from wattspan.models import registry
from wattspan.models.iforest import tree_samples
from wattspan.models.scoring import AnomalyDetector
from wattspan.operators import features, resample
from wattspan.plans import reads, training
from wattspan.schema import METRICS, POWER, VOLTAGE
from wattspan.sources import messages, synthetic
from wattspan.sources.readings import append_readings, compact_readings, read_readings
from wattspan.streaming import live


def lines(day: int, n: int, power: float = 1.25) -> str:
    return "".join(f"{day:02d}/03/2021;08:{i:02d}:00;{power + i:.3f};0.100;231.500;5.400;0.000;2.000;9.000\n" for i in range(n))


def ingest(spark, folder, table, checkpoint, **options):
    live.ingest_stream(live.read_line_stream(spark, str(folder)), str(table), str(checkpoint), **options).awaitTermination()


def test_two_streams_and_a_new_checkpoint_lose_nothing(spark, tmp_path):
    table = tmp_path / "table"
    for name, day, site in (("a", 1, "home-01"), ("b", 1, "home-02")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text(lines(day, 4))
        ingest(spark, tmp_path / name, table, tmp_path / f"progress-{name}", site_id=site)
    assert {r["site_id"]: r["count"] for r in read_readings(spark, str(table)).groupBy("site_id").count().collect()} == {"home-01": 4, "home-02": 4}
    ingest(spark, tmp_path / "a", table, tmp_path / "fresh", site_id="home-01")
    assert read_readings(spark, str(table)).count() == 12
    ingest(spark, tmp_path / "a", table, tmp_path / "fresh", site_id="home-01")
    assert read_readings(spark, str(table)).count() == 12


def test_row_limit_counts_the_rows_of_its_own_stream(spark, tmp_path):
    table = tmp_path / "table"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.txt").write_text(lines(2, 9))
    stored = spark.createDataFrame([(datetime(2021, 3, 1), *[1.0] * 7)], f"timestamp timestamp_ntz, {', '.join(f'{m} double' for m in METRICS)}")
    append_readings(stored, str(table))
    ingest(spark, tmp_path / "raw", table, tmp_path / "progress", max_rows=6)
    assert read_readings(spark, str(table)).count() == 7


def test_a_repeated_load_replaces_only_itself_and_nan_is_null(spark, tmp_path):
    table, schema = str(tmp_path / "table"), f"timestamp timestamp_ntz, {', '.join(f'{m} double' for m in METRICS)}"
    rows = [(datetime(2021, 3, 1, h), float("nan"), *[1.0] * 6) for h in (1, 2)]
    for load in ("one", "two", "one"):
        append_readings(spark.createDataFrame(rows, schema), table, load=load)
    stored = read_readings(spark, table)
    assert stored.count() == 4 and stored.where(F.col(POWER).isNull()).count() == 4
    assert stored.select("id").distinct().count() == 4


def test_compaction_keeps_every_row(spark, tmp_path):
    table, schema = str(tmp_path / "table"), f"timestamp timestamp_ntz, {', '.join(f'{m} double' for m in METRICS)}"
    for i in range(5):
        append_readings(spark.createDataFrame([(datetime(2021, 3, 1 + i // 4, i), *[float(i)] * 7)], schema), table, site_id="a b=c")
    before = sorted(map(tuple, read_readings(spark, table).drop("load").collect()))
    assert compact_readings(spark, table, loads=3) == 1
    after = read_readings(spark, table)
    assert sorted(map(tuple, after.drop("load").collect())) == before
    assert after.groupBy("day").agg(F.countDistinct("load").alias("n")).where("n > 1").count() == 0


def test_rows_of_an_earlier_time_are_set_aside(spark, tmp_path):
    rows = synthetic.generate_dataset(spark, 2, datetime(2024, 1, 1)).withColumnRenamed("seq", "id").drop("injected")
    rows = rows.withColumns({"site_id": F.lit("home-01"), "device_id": F.lit("m")}).cache()
    training.train_models(rows, str(tmp_path / "models"), trees=5)
    for cond in ("id < 2000", "id >= 2000 OR id = 5", "id = 7"):
        rows.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.read_reading_stream(spark, str(tmp_path / "in"), 1)
    tail = tmp_path / "tail"
    live.score_stream(stream, AnomalyDetector(spark, str(tmp_path / "models")), str(tmp_path / "out"), str(tail), str(tmp_path / "progress")).awaitTermination()
    late = spark.read.parquet(str(tail / "late")).select("id").collect()
    assert {r["id"] for r in late} >= {7} and len(late) >= 1
    assert len([p for p in tail.iterdir() if p.name.startswith("batch=")]) == 2


def test_one_sampling_rule_gives_full_trees_at_every_size(spark):
    for n in (10, 300, 2000, 40_000):
        vectors = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("features"))
        sizes = {r["count"] for r in tree_samples(vectors, n, trees=20).groupBy("tree").count().collect()}
        assert sizes == {min(n, 256)}


def test_a_batch_without_history_is_an_error_and_lof_scores_buckets(spark, tmp_path):
    rows = synthetic.generate_dataset(spark, 3, datetime(2024, 1, 1)).withColumnRenamed("seq", "id").drop("injected")
    rows = rows.withColumns({"site_id": F.lit("home-01"), "device_id": F.lit("m")}).cache()
    training.train_models(rows, str(tmp_path / "models"), trees=5, compare=True)
    detector = AnomalyDetector(spark, str(tmp_path / "models"))
    assert detector.model_info["model_name"] == "lof"
    with pytest.raises(ValueError, match="too few"):
        detector.score_batch(rows.where("id < 100"))
    found = reads.get_timeseries(rows, start="2024-01-01 00:00:00", end="2024-01-03 23:59:00", rule="2min", detector=detector)
    assert found.where("anomaly_score IS NOT NULL").count() > 0


def test_nan_counts_as_missing_in_the_matrix(spark):
    rows = synthetic.generate_dataset(spark, 1, datetime(2024, 1, 1)).withColumnRenamed("seq", "id").drop("injected")
    rows = rows.withColumn("site_id", F.lit("a")).withColumn(VOLTAGE, F.when(F.col("id") == 1000, float("nan")).otherwise(F.col(VOLTAGE)))
    assert features.build_feature_matrix(rows).where("id = 1000").count() == 0


def test_a_registry_that_cannot_be_read_is_no_empty_registry(spark, tmp_path):
    assert registry.read_registry(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "model_registry").mkdir()
    (tmp_path / "model_registry" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        registry.read_registry(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("rule,micros", [("1h30min", 5_400_000_000), ("1.5h", 5_400_000_000), ("500ms", 500_000), ("2D", 172_800_000_000), ("h", 3_600_000_000)])
def test_bucket_rules(rule, micros):
    assert rule_micros(rule) == micros


@pytest.mark.parametrize("rule", ["", "5", "0min", "3x", "min5", "0.1us"])
def test_bad_bucket_rules(rule):
    with pytest.raises(ValueError):
        rule_micros(rule)


def test_weeks_and_months_are_labelled_by_their_last_day(spark):
    start = datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("s", start + timedelta(days=i), *[float(i)] * 7) for i in (0, 6, 7, 45)], f"site_id string, timestamp timestamp_ntz, {', '.join(f'{m} double' for m in METRICS)}")
    weeks = [r["bucket"] for r in resample.resample_mean(rows, "W").orderBy("bucket").collect()]
    assert weeks == [datetime(2024, 1, 7), datetime(2024, 1, 14), datetime(2024, 2, 18)]
    full = [r["bucket"] for r in resample.resample_mean_full(rows, "ME").orderBy("bucket").collect()]
    assert full == [datetime(2024, 1, 31), datetime(2024, 2, 29)]


@pytest.mark.parametrize(
    "change,wanted",
    [
        ({"schema_version": 1.0}, "schema_version is not a string"),
        ({"device_id": None}, "device_id is not a string"),
        ({"metrics": [1]}, "metrics is not an object"),
        ({"metrics": {POWER: "2.5"}}, f"metrics.{POWER} is not a number"),
        ({"metrics": {POWER: 2, VOLTAGE: None}}, f"metrics.{VOLTAGE} is not a number"),
        ({"metrics": {POWER: 2}}, ""),
    ],
)
def test_types_of_a_message(spark, change, wanted):
    message = {"schema_version": "1.0", "site_id": "h", "device_id": "m", "timestamp": "2021-03-01T08:00:00Z", "metrics": {POWER: 0.5}} | change
    found = messages.parse_messages(spark.createDataFrame([(json.dumps(message),)], "value string")).first()["violations"]
    assert (wanted in found) if wanted else found == []


def test_look_back_reads_a_few_day_folders(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = synthetic.generate_dataset(spark, 40, datetime(2024, 1, 1)).withColumnRenamed("seq", "id").drop("injected")
    # a gap of some days, and a sparse time before it
    rows = rows.where((F.col("timestamp") < "2024-01-20") & (F.col("id") % 2 == 0) | (F.col("timestamp") >= "2024-01-30"))
    append_readings(rows.withColumn("site_id", F.lit("home-01")), table)
    site = read_readings(spark, table).where("site_id = 'home-01'")
    files = lambda df: {r[0].split("day=")[1][:10] for r in df.select(F.input_file_name()).distinct().collect()}
    for first, days in ((datetime(2024, 2, 8), 2), (datetime(2024, 1, 30, 6), 16), (datetime(2024, 1, 2), 1)):
        held = reads.look_back(site, first, 1439)
        every = site.where(F.col("timestamp") < F.lit(first))
        assert held.count() >= min(1439, every.count()) and len(files(held)) <= days < len(files(site))
        newest = lambda df: [r["id"] for r in df.orderBy(F.desc("timestamp"), F.desc("id")).limit(1439).collect()]
        assert newest(held) == newest(every)
    assert reads.look_back(site, datetime(2024, 1, 1), 1439).count() == 0


def test_two_trainings_at_once_have_two_versions(spark, tmp_path):
    path, entry = str(tmp_path / "models"), {f.name: None for f in registry.ENTRY}

    def train(_):
        number = registry.claim_version(spark, path)
        time.sleep(0.5)
        registry.append_entry(spark, path, {**entry, "seq": number, "version": f"{number}.0", "model_name": "m"})
        return number

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(train, range(6)))
    assert sorted(numbers) == list(range(1, 7))
    assert sorted(r["seq"] for r in registry.read_registry(spark, path).collect()) == list(range(1, 7))
    assert registry.get_next_version(spark, path) == "7.0"
    assert registry.load_entry(spark, path)["version"] == "6.0"
