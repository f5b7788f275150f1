"""Readings to a registered model."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.models import registry
from wattspan.models.evaluate import flag, score_offset, score_statistics
from wattspan.models.iforest import SAMPLE, TREES, fit_forest, forest_scorer
from wattspan.models.lof import NEIGHBOURS, fit_lof, save_index, score_lof
from wattspan.models.scaler import fit_scaler, scaled_vector
from wattspan.models.scoring import index_path
from wattspan.operators.features import build_feature_matrix, get_numeric_features
from wattspan.operators.filters import by_site, exact_sample
from wattspan.schema import ORDER, SITE

CONTAMINATION = 0.01
IDENTITY = [SITE, *ORDER]


def load_training_data(readings: DataFrame, site_id: str | None = "home-01", sample_frac: float | None = None) -> DataFrame:
    """Feature matrix of one site (or all), written once because training reads it several times."""
    rows = readings if site_id is None else by_site(readings, site_id)
    if sample_frac is not None and sample_frac < 1.0:
        # features look back over the sampled rows, so the sample comes first
        rows = durable(exact_sample(rows, sample_frac), "sample")
    matrix = durable(build_feature_matrix(rows), "matrix")
    if matrix.isEmpty():
        raise ValueError(f"No data found for site_id={site_id!r}")
    return matrix


def save_model(
    spark: SparkSession,
    models_dir: str,
    name: str,
    model: DataFrame,
    scaler: DataFrame,
    features: list[str],
    stats,
    offset: float,
    sample_size: int,
) -> str:
    """Write the model tables and append the entry; returns the version, which no other training can have."""
    number = registry.claim_version(spark, models_dir)
    version = f"{number}.0"
    base = models_dir.rstrip("/")
    model_table, scaler_table = f"{base}/anomaly_{name}_v{version}", f"{base}/scaler_v{version}"
    model.write.parquet(model_table)
    scaler.write.parquet(scaler_table)
    entry = {
        "seq": number,
        "version": version,
        "model_name": name,
        "model_table": model_table,
        "scaler_table": scaler_table,
        "feature_names": features,
        "training_date": datetime.now().isoformat(),
        "n_training_samples": stats["n_total"],
        "anomaly_rate": stats["anomaly_rate"],
        "score_offset": offset,
        "sample_size": sample_size,
        "score_stats": tuple(stats[s] for s in registry.STATS),
    }
    registry.append_entry(spark, models_dir, entry)
    return version


def train_models(
    readings: DataFrame,
    models_dir: str,
    site_id: str | None = "home-01",
    contamination: float = CONTAMINATION,
    compare: bool = False,
    sample_frac: float | None = None,
    exclude_self: bool = True,
    trees: int = TREES,
    seed: int = 42,
    neighbours: str = "descent",
) -> dict:
    """Train, evaluate and register an Isolation Forest and, to compare, a LOF model.

    Returns per model its version, its statistics (one row) and its scored
    training rows. ``exclude_self=False`` evaluates LOF with each training row
    as its own neighbour. ``neighbours`` is the search that LOF is fitted with; unless it is ``exact``, an index
    is stored with the model, and scoring probes that.
    """
    spark = readings.sparkSession
    matrix = load_training_data(readings, site_id, sample_frac)
    names = get_numeric_features(matrix)
    scaler = durable(fit_scaler(matrix, names).coalesce(1), "scaler")
    scaler_rows = scaler.collect()
    vectors = matrix.select(*IDENTITY, scaled_vector(scaler_rows).alias("features"))
    n = matrix.count()
    results = {}

    nodes = durable(fit_forest(vectors, n, seed, trees), "forest")
    size = min(SAMPLE, n)
    raw = vectors.withColumn("raw_score", forest_scorer(spark, nodes, size)("features")).drop("features")
    results["isolation_forest"] = _finish(
        spark, models_dir, "isolation_forest", nodes, scaler, names, durable(raw, "raw"), contamination, size
    )

    if compare:
        k = min(NEIGHBOURS, n - 1)
        keyed = durable(vectors.withColumn("_key", F.monotonically_increasing_id()), "keyed")
        plain = keyed.select(F.col("_key").alias("id"), "features")
        model, factor = fit_lof(plain, k, neighbours)
        fitted = durable(factor, "factors")
        offset_rows = fitted.select((-F.col("lof")).alias("raw_score"))
        offset = score_offset(offset_rows, contamination)
        if not exclude_self:
            method = "hashed" if neighbours == "descent" else neighbours
            fitted = durable(score_lof(plain, model, k, method=method), "factors")
        raw = keyed.drop("features").join(fitted.select(F.col("id").alias("_key"), (-F.col("lof")).alias("raw_score")), "_key")
        raw = raw.drop("_key")
        results["lof"] = _finish(
            spark, models_dir, "lof", model, scaler, names, durable(raw, "raw"), contamination, k, offset
        )
        if neighbours != "exact":
            save_index(model, index_path(registry.load_entry(spark, models_dir, results["lof"]["version"])["model_table"]))
    return results


def _finish(spark, models_dir, name, model, scaler, names, raw, contamination, size, offset=None) -> dict:
    offset = score_offset(raw, contamination) if offset is None else offset
    scored = flag(raw.withColumn("anomaly_score", F.col("raw_score") - F.lit(offset)).drop("raw_score"))
    stats = score_statistics(scored, name).first()
    version = save_model(spark, models_dir, name, model, scaler, names, stats, offset, size)
    return {"version": version, "stats": stats, "scored": scored}


def compare_models(results: dict) -> DataFrame:
    """One row per model beside the number of rows that all of them flag."""
    frames = [score_statistics(r["scored"], name) for name, r in results.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    flagged = None
    for r in results.values():
        ids = r["scored"].where("is_anomaly").select(*IDENTITY)
        flagged = ids if flagged is None else flagged.join(ids, IDENTITY, "left_semi")
    both = flagged.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.select("model_name", "n_total", "n_anomalies", "anomaly_rate", both.alias("flagged_by_all"))
