"""Windows, features, resampling, quantiles and filters against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspan.functions.clock import rule_micros
from wattspan.operators import features, filters, joins, ordering, profile, quantiles, ranking, resample, windows
from wattspan.schema import METRICS, POWER


@pytest.fixture(scope="module")
def copies(spark, readings):
    """Readings with one row repeated so that a third of a site shares a timestamp."""
    hot = readings.where("id = 7").crossJoin(spark.range(400).withColumnRenamed("id", "k"))
    hot = hot.withColumn("id", F.lit(100000) + F.col("k")).drop("k")
    return readings.unionByName(hot).cache()


def ordered(df):
    return df.toPandas().sort_values(["site_id", "timestamp", "id"]).reset_index(drop=True)


def test_row_numbers_match_one_task_sort(copies):
    plain = Window.partitionBy("site_id").orderBy("timestamp", "id")
    got = ordering.number_rows(copies).withColumn("want", F.row_number().over(plain))
    assert got.where("rn <> want").count() == 0 and got.count() == copies.count()


def test_last_rows(copies):
    plain = Window.partitionBy("site_id").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    want = copies.withColumn("k", F.row_number().over(plain)).where("k <= 120").select("id")
    got = ordering.last_rows(copies, 120).select("id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("widths", [[60, 360, 1440], [7, 30, 97], [1, 2]])
def test_rolling_matches_pandas(readings, widths):
    got = ordered(windows.add_rolling_features(readings, windows=widths, chunk_rows=100))
    for _, site in got.groupby("site_id"):
        for w in widths:
            roll = site[POWER].rolling(w, min_periods=w // 2)
            for stat in ("mean", "std", "min", "max"):
                have = site[f"{POWER}_roll_{stat}_{windows.rolling_label(w)}"].to_numpy(dtype=float)
                np.testing.assert_allclose(have, getattr(roll, stat)().to_numpy(), atol=1e-12)


def test_rolling_skips_nulls(readings):
    holes = readings.withColumn(POWER, F.when(F.col("id") % 3 != 0, F.col(POWER)))
    got = ordered(windows.add_rolling_features(holes, windows=[60]))
    site = got[got.site_id == "home-01"]
    want = site[POWER].rolling(60, min_periods=30).std()
    np.testing.assert_allclose(site[f"{POWER}_roll_std_1h"].to_numpy(dtype=float), want.to_numpy(), atol=1e-12)


def test_rolling_steps_always_end():
    for w in range(1, 3000, 7):
        steps = windows.rolling_steps([w, 1439])
        assert all(sum(parts) == width for width, parts in steps)


def test_window_labels_must_differ(readings):
    with pytest.raises(ValueError):
        windows.add_rolling_features(readings, windows=[60, 90])


@pytest.mark.parametrize("chunk_rows", [60, 100, 7200])
def test_lags_do_not_depend_on_chunks(readings, chunk_rows):
    got = ordered(windows.add_lag_features(readings, chunk_rows=chunk_rows))
    for _, site in got.groupby("site_id"):
        for k in (1, 5, 15, 60):
            pd.testing.assert_series_equal(site[f"{POWER}_lag_{k}m"], site[POWER].shift(k), check_names=False)


def test_matrix_columns_and_dropped_rows(readings):
    full = features.build_feature_matrix(readings, drop_na=False).toPandas()
    matrix = features.build_feature_matrix(readings)
    names = features.feature_names()
    assert len(names) == 42 and features.get_numeric_features(matrix) == names
    kept = matrix.toPandas().sort_values("id").reset_index(drop=True)
    slow = full.dropna().sort_values("id").reset_index(drop=True)
    assert len(kept) == 143
    pd.testing.assert_frame_equal(kept, slow)
    assert full["metered_ratio"].min() >= 0 and full["metered_ratio"].max() <= 1.5
    assert (full["sub_1_share"] + full["sub_2_share"] + full["sub_3_share"]).max() < 1 + 1e-9
    with pytest.raises(ValueError, match="hour"):
        features.require_features(matrix.drop("hour"), names)


def test_matrix_plan_has_no_site_wide_window(readings):
    plan = features.build_feature_matrix(readings)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "[site_id" in line:
            assert "_slot" in line or "_chunk" in line


@pytest.mark.parametrize("rule", ["5min", "15min", "1h", "7h", "1D"])
def test_resample_matches_pandas(readings, rule):
    got = resample.resample_mean_full(readings, rule).toPandas()
    raw = readings.toPandas()
    for site, rows in raw.groupby("site_id"):
        want = rows.set_index("timestamp")[METRICS].resample(rule.replace("D", "D"), origin="start_day").mean()
        have = got[got.site_id == site].set_index("bucket").sort_index()[METRICS]
        assert list(have.index) == list(want.index)
        np.testing.assert_allclose(have.to_numpy(dtype=float), want.to_numpy(), atol=1e-9)


def test_bad_rule():
    with pytest.raises(ValueError):
        rule_micros("3 fortnights")


MARKS = {"a": 0.0, "b": 0.01, "c": 0.37, "d": 0.5, "e": 0.99, "f": 1.0}


def test_quantiles_match_numpy(copies):
    rows = copies.select("site_id", *METRICS).toPandas()
    for r in quantiles.exact_quantiles(copies, POWER, MARKS, ["site_id"]).collect():
        values = rows[rows.site_id == r["site_id"]][POWER]
        np.testing.assert_allclose([r[m] for m in MARKS], values.quantile(list(MARKS.values())), atol=1e-12)
        assert r["n"] == len(values)
    r = quantiles.exact_quantiles(copies, "voltage_v", MARKS).first()
    np.testing.assert_allclose([r[m] for m in MARKS], rows["voltage_v"].quantile(list(MARKS.values())), atol=1e-9)


@pytest.mark.parametrize("kind", ["normal", "wide", "tiny", "edges", "one"])
def test_quantiles_of_any_doubles(spark, kind):
    draw = np.random.default_rng(3)
    x = {
        "normal": draw.normal(0, 1, 3_000),
        "wide": draw.choice([-1.0, 1.0], 3_000) * 10 ** draw.uniform(-300, 300, 3_000),
        "tiny": np.arange(1, 400) * 5e-324,
        "edges": np.array([-np.inf, -1.7e308, -0.0, 0.0, 5e-324, 1.7e308, np.inf, 1.0, np.nextafter(1.0, 2.0)] * 3),
        "one": np.full(500, 2.5),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    marks = {f"m{i}": i / 16 for i in range(17)}
    r = quantiles.exact_quantiles(df, "v", marks).first()
    at = np.sort(x)[[int(np.floor(p * (len(x) - 1))) for p in marks.values()]]
    above = np.sort(x)[[int(np.ceil(p * (len(x) - 1))) for p in marks.values()]]
    got = np.array([r[m] for m in marks])
    assert r["n"] == len(x) and (got >= at).all() and (got <= above).all()
    exact = [i for i, p in enumerate(marks.values()) if float(p * (len(x) - 1)).is_integer()]
    assert (got[exact] == at[exact]).all()


def test_quantiles_sort_no_values(copies):
    plan = quantiles.exact_quantiles(copies, POWER, MARKS, ["site_id"])._jdf.queryExecution().toString()
    assert "_bin" not in plan and "Window" not in plan
    assert quantiles.exact_quantiles(copies.where("false"), POWER, MARKS, ["site_id"]).collect() == []


def test_sketches_merge_to_any_range(copies, tmp_path):
    path = str(tmp_path / "sketches")
    quantiles.daily_sketches(copies, POWER, k=200).write.parquet(path)
    sketches, rows = copies.sparkSession.read.parquet(path), copies.select("site_id", "timestamp", POWER).toPandas()
    for start, end in (("2024-01-05", "2024-01-09"), (None, "2024-01-20"), (None, None)):
        found = quantiles.sketched_quantiles(sketches, MARKS, start, end, k=200)
        assert "Scan ExistingRDD" not in found._jdf.queryExecution().toString()
        for r in found.collect():
            own = rows[rows.site_id == r["site_id"]].set_index("timestamp").sort_index()
            own = own.loc[start : None if end is None else f"{end} 23:59:59.999999", POWER].to_numpy()
            assert r["n"] == len(own)
            for mark, p in MARKS.items():
                off = max((own < r[mark]).mean() - p, p - (own <= r[mark]).mean(), 0)
                assert off <= quantiles.rank_error(200)


def test_sample_is_exact_and_stable(readings):
    for fraction in (0.0, 0.137, 0.5, 1.0):
        first = filters.exact_sample(readings, fraction).select("id")
        again = filters.exact_sample(readings.repartition(7), fraction).select("id")
        assert first.count() == round(fraction * 1000) and first.exceptAll(again).count() == 0


def test_nearest_bucket_ties_go_later(spark):
    rows = "SELECT 's' site_id, 1L id, timestamp_ntz'{}' timestamp"
    events = spark.sql(" UNION ALL ".join(rows.format(f"2024-01-01 {t}") for t in ("00:30:00", "03:29:59", "09:00:00")))
    buckets = spark.sql(
        "SELECT 's' site_id, explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 05:00:00', interval 1 hour)) bucket"
    )
    got = joins.nearest_buckets(events, buckets, "1h").toPandas().bucket.dt.hour
    assert sorted(got) == [1, 3, 5]


def test_correlations_match_pandas(readings):
    got = profile.correlation_matrix(readings).toPandas()
    wide = profile.pair_correlations(readings, METRICS).toPandas()
    for site, rows in readings.toPandas().groupby("site_id"):
        want = rows[METRICS].corr()
        for table in (got, wide):
            for r in table[table.site_id == site].itertuples():
                assert r.correlation == pytest.approx(want.loc[r.feature_1, r.feature_2], abs=1e-9)


def test_hours_are_rows(readings):
    assert filters.last_hours(filters.by_site(readings), 2).count() == 120
    with pytest.raises(ValueError):
        filters.last_hours(readings, 200)


@pytest.fixture(scope="module")
def clusters(spark):
    """Half of the values equal, ids in two far clusters."""
    ids = "CASE WHEN id % 2 = 0 THEN id ELSE id + 9000000000000000 END AS id"
    return spark.range(4000).selectExpr(ids, "'s' AS site_id", "CASE WHEN id % 4 < 2 THEN 0.0 ELSE -(id % 10) / 8 END AS d").cache()


def test_ranks_of_equal_values_and_clustered_ids(clusters):
    got = ranking.ranked_changes(clusters, "d", piece_rows=100).orderBy("rank").collect()
    expected = sorted((abs(r["d"]), r["id"]) for r in clusters.collect())
    assert [(r["abs_change"], r["id"]) for r in got] == expected and [r["rank"] for r in got] == list(range(1, 4001))
    assert ranking.ranked_changes(clusters.where("false"), "d").collect() == []


def test_pieces_are_of_like_size(clusters):
    sizes = [r["count"] for r in ordering.in_pieces(clusters, ["site_id"], ["d"], 100).groupBy("_piece").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 400 and len(sizes) > 20


def test_nearest_targets_at_any_times(spark):
    draw = np.random.default_rng(5)
    at = lambda minutes: [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=int(m)) for m in minutes]
    sites = ["a", "b", "none", None]
    events = [(str(draw.choice(["a", "a", "a", "b", "none"])), i, t) for i, t in enumerate(at(draw.integers(0, 3_000, 1_500)))]
    events += [("a", 5_000 + i, pd.Timestamp("2024-01-01 10:00:00")) for i in range(700)] + [("a", 9_000, None), (None, 9_001, at([5])[0])]
    marks = [(str(draw.choice(["a", "b"])), t) for t in at(draw.integers(500, 2_000, 80) * 2)] * 2 + [("b", None)]
    left = spark.createDataFrame([(s, i, t.to_pydatetime() if t is not None else None) for s, i, t in events], "site_id string, id long, timestamp timestamp_ntz")
    right = spark.createDataFrame([(s, t.to_pydatetime() if t is not None else None) for s, t in marks], "site_id string, timestamp timestamp_ntz")
    times = {s: sorted({t for site, t in marks if site == s and t is not None}) for s in sites}
    want = {}
    for s, i, t in events:
        near = min(times[s], key=lambda x: (abs(x - t), -x.value)) if times[s] and t is not None else None
        want[i] = near
    for rows in (60, 100_000):
        got = {r["id"]: r["nearest"] for r in joins.nearest_targets(left, right, piece_rows=rows).collect()}
        assert {i: got[i] and pd.Timestamp(got[i]) for i in got} == {i: t for i, t in want.items() if i in got}
        assert set(want) - set(got) <= {9_001}
