"""Score statistics and counts of flagged rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.functions.energy import half_up
from wattspan.operators.quantiles import attach, exact_quantiles

SCORE_MARKS = {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}


def flag(scored: DataFrame) -> DataFrame:
    """``is_anomaly`` and ``prediction`` (-1 or 1) from the sign of the score."""
    below = F.col("anomaly_score") < 0
    return scored.withColumns({"is_anomaly": below, "prediction": F.when(below, -1).otherwise(1)})


def score_offset(raw: DataFrame, contamination: float, column: str = "raw_score") -> float:
    """The raw score below which a share of ``contamination`` of the training rows lies."""
    return exact_quantiles(raw, column, {"offset": contamination}).first()["offset"]


def score_statistics(scored: DataFrame, model_name: str, keys=()) -> DataFrame:
    """Mean, population deviation, extremes and percentiles of the score, and the flagged share, per key."""
    basic = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("is_anomaly").alias("n_anomalies"),
        F.avg("anomaly_score").alias("mean"),
        F.stddev_pop("anomaly_score").alias("std"),
        F.min("anomaly_score").alias("min"),
        F.max("anomaly_score").alias("max"),
    )
    marks = exact_quantiles(scored, "anomaly_score", SCORE_MARKS, keys).drop("n")
    rate = half_up(F.col("n_anomalies") / F.nullif("n_total", F.lit(0)), 4)
    return attach(basic, marks, keys).select(F.lit(model_name).alias("model_name"), "*", rate.alias("anomaly_rate"))


def batch_totals(scored: DataFrame, keys=()) -> DataFrame:
    counted = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomaly_count")
    )
    rate = F.col("anomaly_count") / F.nullif("total", F.lit(0))
    return counted.withColumns({"anomaly_rate": half_up(rate, 4), "anomaly_pct": half_up(rate * 100, 2)})
