"""Model registry: an append-only table of entries and the rules to pick one."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.durable import exists, file_system

STATS = ["mean", "std", "min", "max", "p01", "p05", "p95", "p99"]

ENTRY = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_table", T.StringType()),
        T.StructField("scaler_table", T.StringType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("training_date", T.StringType()),
        T.StructField("n_training_samples", T.LongType()),
        T.StructField("anomaly_rate", T.DoubleType()),
        T.StructField("score_offset", T.DoubleType()),
        T.StructField("sample_size", T.LongType()),
        T.StructField("score_stats", T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])),
    ]
)


def registry_path(models_dir: str) -> str:
    return f"{models_dir.rstrip('/')}/model_registry"


def read_registry(spark: SparkSession, models_dir: str) -> DataFrame:
    """All entries; an empty table when nothing was saved yet."""
    if not exists(spark, registry_path(models_dir)):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(registry_path(models_dir)).select(*ENTRY.names)


def next_version(entries: DataFrame, keys=()) -> DataFrame:
    """The whole part of the highest version plus one; 1.0 for an empty registry."""
    top = F.coalesce(F.floor(F.max(F.col("version").cast("double"))), F.lit(0)) + 1
    return entries.groupBy(*keys).agg(F.concat(top.cast("string"), F.lit(".0")).alias("next_version"))


def latest(entries: DataFrame, keys=()) -> DataFrame:
    """The entry appended last, with the number of entries."""
    whole = F.struct(*[c for c in entries.columns if c not in keys])
    picked = entries.groupBy(*keys).agg(F.max_by(whole, "seq").alias("_e"), F.count(F.lit(1)).alias("models"))
    return picked.where(F.col("models") > 0).select(*keys, "_e.*", F.col("models").alias("total_models_in_registry"))


def by_version(entries: DataFrame, version: str, keys=()) -> DataFrame:
    """The last entry saved under ``version``."""
    return latest(entries.where(F.col("version") == version), keys)


def model_info(entries: DataFrame, keys=()) -> DataFrame:
    """Name, version, date, samples, rate and feature count of the latest entry."""
    return latest(entries, keys).select(
        *keys,
        "model_name",
        "version",
        "training_date",
        "n_training_samples",
        "anomaly_rate",
        F.size("feature_names").alias("n_features"),
        "total_models_in_registry",
    )


def get_next_version(spark: SparkSession, models_dir: str) -> str:
    return next_version(read_registry(spark, models_dir)).first()["next_version"]


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file, if there is none: of several callers one succeeds. HDFS does this in one step; Hadoop's
    local file system looks first and creates then, so Java's own step is used there."""
    system, where = file_system(spark, path)
    if system.getUri().getScheme() == "file":
        system.mkdirs(where.getParent())
        return spark.sparkContext._jvm.java.io.File(where.toUri().getPath()).createNewFile()
    try:
        system.create(where, False).close()
        return True
    except Py4JJavaError:
        if not system.exists(where):
            raise
        return False


def claim_version(spark: SparkSession, models_dir: str) -> int:
    """The next version's number, for the caller alone: whoever creates its file has it, and any other one takes
    the next number. A training that fails later leaves its number unused."""
    number = int(float(get_next_version(spark, models_dir)))
    while not _create(spark, f"{models_dir.rstrip('/')}/model_versions/{number}"):
        number += 1
    return number


def append_entry(spark: SparkSession, models_dir: str, entry: dict) -> None:
    """Append an entry; without a ``seq`` of its own it takes a claimed number. Every entry is a folder of its own,
    so that two writers do not share one commit."""
    row = {**entry, "seq": entry.get("seq") or claim_version(spark, models_dir)}
    made = spark.createDataFrame([tuple(row[f.name] for f in ENTRY)], ENTRY).coalesce(1)
    made.write.parquet(f"{registry_path(models_dir)}/entry={row['seq']}")


def load_entry(spark: SparkSession, models_dir: str, version: str | None = None):
    """The chosen entry as a row; raises when the registry or the version is missing."""
    entries = read_registry(spark, models_dir)
    row = (latest(entries) if version is None else by_version(entries, version)).first()
    if row is not None:
        return row
    if entries.isEmpty():
        raise FileNotFoundError(f"No models in registry: {models_dir}")
    raise ValueError(f"Version {version} not found in registry")
