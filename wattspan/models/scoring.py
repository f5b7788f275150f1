"""A trained model applied to feature rows or raw readings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.durable import durable, exists
from wattspan.models import registry
from wattspan.models.evaluate import flag
from wattspan.models.iforest import forest_scorer
from wattspan.models.lof import score_lof, score_with_index
from wattspan.models.scaler import scaled_vector
from wattspan.operators.features import build_feature_matrix, require_features
from wattspan.operators.filters import input_violations
from wattspan.operators.ranking import get_anomalies
from wattspan.schema import ID


def index_path(model_table: str) -> str:
    """Where the neighbour index of a model is kept."""
    return f"{model_table}_index"


class AnomalyDetector:
    """The latest model of a registry, or a given version of it."""

    def __init__(self, spark: SparkSession, models_dir: str, version: str | None = None):
        self.spark = spark
        self.entry = registry.load_entry(spark, models_dir, version)
        self.feature_names = list(self.entry["feature_names"])
        # one row per feature
        self.scaler = spark.read.parquet(self.entry["scaler_table"]).collect()
        self.model = spark.read.parquet(self.entry["model_table"])

    @property
    def model_info(self) -> dict:
        e = self.entry
        return {
            "model_name": e["model_name"],
            "version": e["version"],
            "training_date": e["training_date"],
            "n_training_samples": e["n_training_samples"],
            "anomaly_rate": e["anomaly_rate"],
            "n_features": len(self.feature_names),
        }

    def score_dataframe(self, features: DataFrame) -> DataFrame:
        """Add ``anomaly_score``, ``is_anomaly`` and ``prediction`` to feature rows."""
        require_features(features, self.feature_names)
        vectors = features.withColumn("_features", scaled_vector(self.scaler))
        if self.entry["model_name"] == "isolation_forest":
            score = forest_scorer(self.spark, self.model, self.entry["sample_size"])
            raw = vectors.withColumn("_raw", score("_features"))
        else:
            # a key of its own: buckets have no id, and ids alone may repeat
            vectors = durable(vectors.withColumn("_key", F.monotonically_increasing_id()), "vectors")
            queries = vectors.select(F.col("_key").alias("id"), F.col("_features").alias("features"))
            index = index_path(self.entry["model_table"])
            if exists(self.spark, index):
                factors = score_with_index(queries, index, self.entry["sample_size"])
            else:
                factors = score_lof(queries, self.model, self.entry["sample_size"])
            raw = vectors.join(factors.select(F.col("id").alias("_key"), (-F.col("lof")).alias("_raw")), "_key").drop("_key")
        scored = raw.withColumn("anomaly_score", F.col("_raw") - F.lit(self.entry["score_offset"]))
        return flag(scored.drop("_features", "_raw"))

    def score_raw_readings(self, readings: DataFrame, **options) -> DataFrame:
        return self.score_dataframe(build_feature_matrix(readings, **options))

    def score_batch(self, readings: DataFrame, max_rows: int | None = None) -> DataFrame:
        """Score a table of readings that meet the input rules.

        ``max_rows`` restores the limit of a single request (10,000 readings).
        """
        if max_rows is not None and readings.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"a batch has at most {max_rows} readings")
        broken = readings.where(F.size(input_violations()) > 0).limit(1).collect()
        if broken:
            raise ValueError(f"reading {broken[0][ID]} breaks the input rules")
        scored = self.score_raw_readings(readings)
        if scored.isEmpty():
            raise ValueError("too few readings: none has the history that its features need")
        return scored

    def get_anomalies(self, scored: DataFrame, top_n: int | None = None) -> DataFrame:
        return get_anomalies(scored, top_n)
