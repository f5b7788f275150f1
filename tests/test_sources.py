"""Parsing, bounds, loading and messages."""

import math

import pytest
from pyspark.sql import functions as F

from wattspan.schema import METRICS
from wattspan.sources import fixtures, messages, raw_lines, synthetic
from wattspan.sources import readings as table

GOOD = "28/09/2021;05:41:30;1.375;0.212;228.660;6.100;3.000;0.000;11.500"
CASES = [
    (GOOD, "ok", ""),
    ("  " + GOOD + " \r\n", "ok", ""),
    ("3/4/2020;9:05:07;0.750;0.000;231.000;3.200;0.000;2.000;0.000", "ok", ""),
    (GOOD.replace(";228.660;", ";?;"), "missing", ""),
    ("no date;no time;?;1;1;1;1;1;1", "missing", ""),
    (GOOD + "?", "invalid", "Non-numeric metric value: '11.500?'"),
    (GOOD + ";7", "invalid", "Expected 9 fields, got 10"),
    ("28/09/2021;05:41:30", "invalid", "Expected 9 fields, got 2"),
    ("   ", "invalid", "Expected 9 fields, got 1"),
    (GOOD.replace("28/09", "31/04"), "invalid", "Invalid date/time: 31/04/2021 05:41:30"),
    (GOOD.replace("05:41:30", "24:00:00"), "invalid", "Invalid date/time"),
    (GOOD.replace("11.500", "11,5"), "invalid", "Non-numeric metric value: '11,5'"),
    (GOOD.replace("0.212", ""), "invalid", "Non-numeric metric value: ''"),
    (GOOD.replace("6.100", "6_1.5"), "ok", ""),
    (GOOD.replace("6.100", " 25e-1 "), "ok", ""),
    (GOOD.replace("6.100", "0x10"), "invalid", "Non-numeric"),
]


def lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value string")


def test_parse_outcomes(spark):
    rows = raw_lines.parse_lines(lines(spark, [c[0] for c in CASES])).orderBy("id").collect()
    for row, (_, status, reason) in zip(rows, CASES):
        assert row["status"] == status, row
        assert (row["reason"] or "").startswith(reason), row
        assert (row["timestamp"] is not None) == (status == "ok")
    assert rows[0]["global_active_power"] == 1.375 and rows[0]["sub_metering_3"] == 11.5
    assert rows[13]["global_intensity"] == 61.5 and rows[14]["global_intensity"] == 2.5
    assert str(rows[2]["timestamp"]) == "2020-04-03 09:05:07"


def test_bounds_are_inclusive_and_nan_is_outside(spark):
    values = [
        GOOD,
        GOOD.replace("228.660", "300.5"),
        GOOD.replace("6.100", "-0.1"),
        GOOD.replace("1.375", "15.0").replace("228.660", "300.0"),
        GOOD.replace("1.375", "nan"),
    ]
    rows = raw_lines.validate_lines(lines(spark, values)).orderBy("id")
    assert [len(r["warnings"]) for r in rows.collect()] == [0, 1, 1, 0, 1]
    stored = raw_lines.to_readings(rows).orderBy("id").collect()
    assert stored[4][METRICS[0]] is None and not math.isnan(stored[0][METRICS[0]])


def test_bulk_load_keeps_copies_and_counts(spark, tmp_path):
    source, target = str(tmp_path / "raw.txt"), str(tmp_path / "table")
    body = ["Date;Time;" + ";".join("abcdefg"), *[GOOD] * 3, CASES[3][0], CASES[6][0], GOOD.replace("228.660", "99")]
    (tmp_path / "raw.txt").write_text("\n".join(body) + "\n")
    counters = raw_lines.bulk_load(raw_lines.read_raw_lines(spark, source), target).first().asDict()
    assert counters == {"total_lines": 6, "inserted": 4, "skipped_missing": 1, "skipped_invalid": 1, "warnings": 1}
    raw_lines.bulk_load(raw_lines.read_raw_lines(spark, source), target)
    stored = table.read_readings(spark, target)
    assert stored.count() == 8 and stored.select("id").distinct().count() == 8
    assert stored.select("site_id", "device_id").distinct().collect() == [("home-01", "meter-main")]


def test_empty_file_and_empty_table(spark, tmp_path):
    target = str(tmp_path / "table")
    empty = lines(spark, [GOOD]).where("id < 0")
    counters = raw_lines.bulk_load(empty.drop("id"), target).first()
    assert list(counters) == [0, 0, 0, 0, 0]
    table.init_readings(spark, str(tmp_path / "fresh"))
    table.init_readings(spark, str(tmp_path / "fresh"))
    assert table.read_readings(spark, str(tmp_path / "fresh")).count() == 0


def test_range_reads_prune_days(spark, tmp_path, readings):
    target = str(tmp_path / "table")
    table.append_readings(readings, target)
    found = table.in_range(table.read_readings(spark, target), "2024-01-10 00:00:00", "2024-01-11 00:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:400]
    expected = readings.where("timestamp between timestamp_ntz'2024-01-10' and timestamp_ntz'2024-01-11'").count()
    assert found.count() == expected > 0


def test_messages(spark, readings):
    parsed = messages.parse_messages(fixtures.messages(readings))
    broken = {r["v"] for r in parsed.select(F.explode("violations").alias("v")).distinct().collect()}
    assert {"missing device_id", "schema_version is not 1.0", "unknown key note", "site_id is not a valid name"} <= broken
    assert "metrics.global_active_power_kw is below 0" in broken and "timestamp is not a date-time" in broken
    assert parsed.where(F.size("violations") == 0).count() > 500


def test_generator(spark):
    from datetime import datetime

    start = datetime(2024, 1, 15)
    day = synthetic.generate_dataset(spark, 1, start)
    week = synthetic.generate_dataset(spark, 7, start, anomaly_rate=0.05)
    assert day.count() == 1440 and week.count() == 10080
    again = synthetic.generate_dataset(spark, 1, start).repartition(5)
    assert sorted(map(tuple, day.collect())) == sorted(map(tuple, again.collect()))
    other = synthetic.generate_dataset(spark, 1, start, seed=7)
    assert day.select(METRICS).exceptAll(other.select(METRICS)).count() > 1000
    stats = week.agg(F.avg("voltage_v"), F.min(METRICS[0]), F.avg((F.col("injected") != "none").cast("int"))).first()
    assert 220 < stats[0] < 240 and stats[1] >= 0 and 0.03 < stats[2] < 0.07
    by_kind = {r[0]: r[1] for r in week.groupBy("injected").agg(F.avg(METRICS[0])).collect()}
    assert by_kind["dropout"] < by_kind["none"] < by_kind["spike"]


def test_load_profile(spark):
    from wattspan.functions.energy import load_multiplier

    rows = spark.sql(
        "SELECT timestamp_ntz'2024-01-15 03:00:00' a, timestamp_ntz'2024-01-15 19:00:00' b, "
        "timestamp_ntz'2024-01-15 07:00:00' c, timestamp_ntz'2024-01-20 07:00:00' d, timestamp_ntz'2024-01-15 23:30:00' e"
    )
    a, b, c, d, e = rows.select(*[load_multiplier(F.col(x)) for x in "abcde"]).first()
    assert a < b and d < c and e == pytest.approx(0.175)
