"""Top-k reports and ordered output."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.functions.calendar import iso_text, minute_text
from wattspan.functions.energy import half_up
from wattspan.operators.ordering import PIECE_ROWS, rank_rows
from wattspan.operators.profile import date_range
from wattspan.operators.quantiles import exact_quantiles
from wattspan.operators.windows import add_steps
from wattspan.schema import ID, POWER, SITE, TS, VOLTAGE

SEVERITY = ["anomaly_score", TS, ID]
TOOL_ROWS = 48


def get_anomalies(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """Anomalies, worst first; with ``top_n`` only that many."""
    found = scored.where("is_anomaly").orderBy(*SEVERITY)
    return found if top_n is None else found.limit(top_n)


def anomaly_report(scored: DataFrame, readings: DataFrame, top_n: int = 50) -> DataFrame:
    """Rounded top anomalies with their number and the time range of the readings."""
    if not 1 <= top_n <= 500:
        raise ValueError("top_n must be between 1 and 500")
    top = get_anomalies(scored, top_n)
    span = date_range(readings, ()).select(F.struct("earliest", "latest").alias("s"))
    rows = top.select(
        iso_text().alias("timestamp"),
        half_up("anomaly_score", 4).alias("anomaly_score"),
        half_up(POWER, 3).alias(POWER),
        half_up(VOLTAGE, 2).alias(VOLTAGE),
    )
    found = top.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.withColumn("total_found", found).withColumn("_s", span.scalar()).select(
        "*", iso_text(F.col("_s.earliest")).alias("range_start"), iso_text(F.col("_s.latest")).alias("range_end")
    ).drop("_s")


def anomaly_table(scored: DataFrame, rows: int = 100) -> DataFrame:
    """The display table: the worst anomalies, rounded, beside their total number."""
    total = scored.agg(F.count_if("is_anomaly").alias("n")).scalar()
    return get_anomalies(scored, rows).select(
        minute_text().alias("time"),
        half_up(POWER, 3).alias("power_kw"),
        half_up(VOLTAGE, 1).alias("voltage_v"),
        half_up("anomaly_score", 4).alias("anomaly_score"),
        total.alias("total_anomalies"),
    )


def longest_gaps(df: DataFrame, n: int = 10) -> DataFrame:
    gaps = add_steps(df).where("is_gap").select(SITE, ID, TS, "step_seconds")
    return gaps.orderBy(F.col("step_seconds").desc(), SITE, TS, ID).limit(n)


def first_buckets(resampled: DataFrame, rows: int = TOOL_ROWS) -> DataFrame:
    """The first ``rows`` buckets, with the number returned and whether more were cut off."""
    order = ["bucket", SITE]
    probe = resampled.orderBy(*order).limit(rows + 1)
    seen = probe.agg(F.count(F.lit(1)).alias("n")).scalar()
    return probe.orderBy(*order).limit(rows).select(
        SITE,
        minute_text("bucket").alias("timestamp"),
        half_up(POWER, 3).alias("power_kw"),
        half_up(VOLTAGE, 1).alias("voltage_v"),
        F.least(seen, F.lit(rows)).alias("count"),
        (seen > rows).alias("truncated"),
    )


def change_curve(changes: DataFrame, column: str, keys=(SITE,), points: int = 100) -> DataFrame:
    """Absolute changes in rank order, as their exact percentiles 0..points."""
    marks = {f"_{i}": i / points for i in range(points + 1)}
    wide = exact_quantiles(changes, F.abs(F.col(column)), marks, keys)
    rows = F.array(*[F.struct(F.lit(i).alias("percent"), F.col(f"_{i}").alias("abs_change")) for i in range(points + 1)])
    return wide.select(*keys, F.inline(rows))


def ranked_changes(changes: DataFrame, column: str, keys=(SITE,), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Every absolute change with its rank; ties in the order of their ids."""
    sized = changes.where(F.col(column).isNotNull()).withColumn("abs_change", F.abs(F.col(column)))
    return rank_rows(sized, keys, ["abs_change", ID], "rank", piece_rows)


def in_time_order(df: DataFrame, order=(SITE, TS, ID)) -> DataFrame:
    """Ascending output order, as a range-partitioned sort."""
    return df.orderBy(*order)

