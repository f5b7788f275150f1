"""Neighbours, LOF, Isolation Forest, registry and detector."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspan.models import neighbours, registry
from wattspan.models.iforest import average_path, fit_forest, forest_scorer, tree_samples
from wattspan.models.lof import fit_lof, score_lof
from wattspan.models.scoring import AnomalyDetector
from wattspan.operators.features import build_feature_matrix
from wattspan.plans import reads, training
from wattspan.sources import synthetic


@pytest.fixture(scope="module")
def points(spark):
    """Two clumps, a third of the rows equal, and a few strays."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (150, 4)), rng.normal(20, 0.1, (60, 4)), np.full((110, 4), 3.0), rng.uniform(-50, 50, (10, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")
    return df.repartition(5).cache(), x


def brute(x, k, own):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if own:
        np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("pivots,block", [(1, 1000), (16, 40), (64, 7)])
def test_neighbours_are_exact(points, pivots, block):
    df, x = points
    got = neighbours.nearest_rows(df, df, 6, True, pivots, block).toPandas().sort_values(["query", "rank"])
    ids, distances = brute(x, 6, True)
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(-1, 6), distances, atol=1e-12)
    assert (got["neighbour"].to_numpy().reshape(-1, 6) == ids).all()


def test_lof_matches_definition(points):
    df, x = points
    model, factor = fit_lof(df, 20, pivots=16)
    ids, d = brute(x, 20, True)
    reach = np.maximum(d[:, -1][ids], d)
    density = 1 / (reach.mean(1) + 1e-10)
    want = density[ids].mean(1) / density
    got = factor.orderBy("id").toPandas()["lof"].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)
    again = score_lof(df, model, 20, exclude_self=True, pivots=16).orderBy("id").toPandas()["lof"].to_numpy()
    np.testing.assert_allclose(again, want, rtol=1e-9)
    assert set(np.argsort(got)[-5:]) & set(range(320, 330))


def test_average_path():
    np.testing.assert_allclose(average_path([0, 1, 2, 256]), [0, 0, 1, 10.2448], atol=1e-3)


def test_tree_samples_are_full_in_both_plans(spark):
    rows = spark.range(2000).select("id", F.array(F.col("id").cast("double")).alias("features"))
    for trees, sample in ((4, 100), (50, 256)):
        sizes = tree_samples(rows, 2000, trees=trees, sample=sample).groupBy("tree").count().toPandas()
        assert len(sizes) == trees and (sizes["count"] == sample).all()


def test_forest_does_not_depend_on_partitions(points, spark):
    df, _ = points
    n = df.count()
    scores = []
    for parts in (1, 9):
        nodes = fit_forest(df.repartition(parts), n, trees=30)
        score = forest_scorer(spark, nodes, min(256, n))
        scores.append(df.repartition(parts).select("id", score("features").alias("s")).orderBy("id").toPandas()["s"])
    np.testing.assert_allclose(scores[0], scores[1], rtol=1e-12)
    assert scores[0].iloc[320:].mean() < scores[0].iloc[:150].mean()


@pytest.fixture(scope="module")
def household(spark):
    rows = synthetic.generate_dataset(spark, 3, datetime(2024, 1, 1), anomaly_rate=0.01)
    return rows.withColumnRenamed("seq", "id").withColumns({"site_id": F.lit("home-01"), "device_id": F.lit("m")}).cache()


@pytest.fixture(scope="module")
def trained(household, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    return path, training.train_models(household.drop("injected"), path, contamination=0.02, trees=60)


def test_training_flags_the_contamination_share(household, trained):
    _, results = trained
    scored = results["isolation_forest"]["scored"]
    stats = results["isolation_forest"]["stats"]
    assert results["isolation_forest"]["version"] == "1.0"
    assert abs(stats["n_anomalies"] - 0.02 * stats["n_total"]) <= 1 and stats["p01"] < 0 < stats["mean"]
    by_kind = {
        r[0]: r[1]
        for r in scored.join(household.select("id", "injected"), "id").groupBy("injected").agg(F.avg("anomaly_score")).collect()
    }
    assert by_kind["spike"] < by_kind["none"]


def test_detector_repeats_training_scores(spark, household, trained):
    path, results = trained
    detector = AnomalyDetector(spark, path)
    assert detector.model_info["n_features"] == 42
    scored = detector.score_raw_readings(household.drop("injected"))
    both = scored.select("id", F.col("anomaly_score").alias("a"), "prediction", "is_anomaly").join(
        results["isolation_forest"]["scored"].select("id", "anomaly_score"), "id"
    )
    assert both.where(F.abs(F.col("a") - F.col("anomaly_score")) > 1e-12).count() == 0
    assert {r[0] for r in scored.select("prediction").distinct().collect()} == {-1, 1}
    matrix = build_feature_matrix(household.drop("injected"))
    with pytest.raises(ValueError):
        detector.score_dataframe(matrix.drop("hour"))
    with pytest.raises(ValueError):
        detector.score_batch(household.drop("injected").withColumn("voltage_v", F.lit(0.0)))


def test_registry_versions(spark, household, trained, tmp_path):
    empty = str(tmp_path / "none")
    assert registry.get_next_version(spark, empty) == "1.0"
    with pytest.raises(FileNotFoundError):
        AnomalyDetector(spark, empty)
    path, _ = trained
    assert registry.get_next_version(spark, path) == "2.0"
    with pytest.raises(ValueError):
        AnomalyDetector(spark, path, "9.0")
    assert registry.load_entry(spark, path, "1.0")["model_name"] == "isolation_forest"


def test_reads(spark, household, trained):
    detector = AnomalyDetector(spark, trained[0])
    rows = household.drop("injected")
    plain = reads.get_timeseries(rows, hours=24).toPandas()
    assert len(plain) == 1440 and (plain["total_points"] == 1440).all()
    overlaid = reads.get_timeseries(rows, hours=24, detector=detector).toPandas()
    assert len(overlaid) == 1440 and overlaid["anomaly_score"].isna().sum() >= 719
    whole = reads.get_timeseries(rows, hours=24, detector=detector, context=True).toPandas()
    assert whole["anomaly_score"].notna().sum() > overlaid["anomaly_score"].notna().sum()
    top = reads.get_anomalies(rows, detector, start="2024-01-01", end="2024-01-04", top_n=7).toPandas()
    assert len(top) == 7 and (top["total_found"] == 7).all() and top["anomaly_score"].is_monotonic_increasing
    tables = reads.dashboard(rows, "home-01", "2024-01-01", "2024-01-03", "1h", detector)
    assert set(tables) == {"cards", "consumption", "voltage", "sub_meters", "anomalies"}
    assert tables["consumption"].count() == 72 and tables["consumption"].where("is_marked").count() > 0
