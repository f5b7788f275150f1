"""The readings table: Parquet, partitioned by site, day and load.

A load is one append, or one micro-batch of one stream. Repeating a load replaces its
own rows and no others; :func:`compact_readings` joins the loads of a day.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.durable import durable, remove
from wattspan.schema import DEVICE, ID, METRICS, ORDER, READINGS_SCHEMA, SITE, TS

# folders of the table: site and day, which filters prune, then one per load
TABLE_SCHEMA = T.StructType([*READINGS_SCHEMA, T.StructField("load", T.StringType()), T.StructField("day", T.DateType())])


def with_ids(df: DataFrame, load: str | None = None) -> DataFrame:
    """Give rows without an id one of their own, also when the rows are equal.

    The id hashes the load and the row's place in it, so copies of a row and
    rows of other loads stay apart. Two rows of a few billion may get one id; site,
    timestamp and id together are the key of a reading.
    """
    if ID in df.columns:
        return df
    return df.withColumn(ID, F.xxhash64(F.lit(load or uuid.uuid4().hex), F.monotonically_increasing_id()))


def append_readings(
    df: DataFrame, path: str, site_id: str = "home-01", device_id: str = "meter-main", load: str | None = None
) -> None:
    """Append readings under a site and device; an empty batch adds no rows.

    Only the folders of ``load`` are written, so repeating it (a retried
    micro-batch) replaces its rows, while two loads of the same file keep both
    copies. A metric that is NaN is stored as null.
    """
    load = load or uuid.uuid4().hex
    missing = F.lit(None).cast("double")
    rows = with_ids(df, load).select(
        F.col(ID).cast("long").alias(ID),
        TS,
        (F.col(SITE) if SITE in df.columns else F.lit(site_id)).alias(SITE),
        (F.col(DEVICE) if DEVICE in df.columns else F.lit(device_id)).alias(DEVICE),
        *[F.nanvl(F.col(m).cast("double"), missing).alias(m) for m in METRICS],
        F.current_timestamp().alias("ingested_at"),
        F.to_date(TS).alias("day"),
        F.lit(load).alias("load"),
    )
    _write(rows, path)


def _write(rows: DataFrame, path: str) -> None:
    # a site-day goes to a few files: several tasks for a hot day, no file per task and day
    spread = rows.repartition(SITE, "day", F.hour(TS))
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(SITE, "day", "load").parquet(path)


def compact_readings(spark: SparkSession, path: str, loads: int = 8) -> int:
    """Join the loads of every site-day that has more than ``loads`` of them; returns how many days.

    The joined load is written before the old ones go, so a failure in between leaves
    copies and loses nothing; run it while no other job writes to or reads from the table.
    """
    table = read_readings(spark, path)
    held = durable(table.groupBy(SITE, "day").agg(F.collect_set("load").alias("loads")).where(F.size("loads") > loads), "loads")
    days = held.count()
    if not days:
        return 0
    name = f"joined-{uuid.uuid4().hex}"
    _write(table.join(held.select(SITE, "day"), [SITE, "day"], "left_semi").withColumn("load", F.lit(name)), path)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in held.toLocalIterator():
        for load in row["loads"]:
            remove(spark, f"{path}/{SITE}={escape(row[SITE])}/day={row['day']}/load={escape(load)}")
    return days


def init_readings(spark: SparkSession, path: str) -> None:
    """Create the table if it does not exist; an existing one is left as it is."""
    spark.createDataFrame([], TABLE_SCHEMA).write.mode("ignore").partitionBy(SITE, "day", "load").parquet(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def scan_site(df: DataFrame, site_id: str = "home-01", ordered: bool = False) -> DataFrame:
    """Timestamp and metrics of one site; sorted only when the output needs it."""
    site = df.where(F.col(SITE) == site_id)
    if ordered:
        site = site.orderBy(*ORDER)
    return site.select(TS, *METRICS)


def in_range(df: DataFrame, start, end, half_open: bool = False) -> DataFrame:
    """Rows between two timestamps; also prunes day partitions when the table has them."""
    low, high = _ntz(start), _ntz(end)
    upper = F.col(TS) < high if half_open else F.col(TS) <= high
    out = df.where((F.col(TS) >= low) & upper)
    if "day" in df.columns:
        out = out.where(F.col("day").between(F.to_date(low), F.to_date(high)))
    return out


def _ntz(moment):
    if isinstance(moment, Column):
        return moment
    text = moment if isinstance(moment, str) else moment.isoformat(" ")
    return F.lit(text).cast("timestamp_ntz")
