"""User-level reads: time series, anomalies, statistics and the dashboard's tables."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.functions.calendar import minute_text
from wattspan.functions.energy import half_up
from wattspan.models.evaluate import batch_totals
from wattspan.models.scoring import AnomalyDetector
from wattspan.operators import filters, joins, profile, ranking, resample
from wattspan.operators.features import build_feature_matrix
from wattspan.schema import ID, METRICS, ORDER, POWER, SITE, TS, VOLTAGE
from wattspan.sources.readings import in_range

LOOK_BACK_ROWS = 1439
EARLIEST = datetime(1, 1, 1)


def site_slice(readings: DataFrame, site_id: str, start=None, end=None, hours: int = 24) -> DataFrame:
    """A site's range when both ends are given, otherwise its last ``hours * 60`` rows."""
    site = filters.by_site(readings, site_id)
    if start is not None and end is not None:
        return in_range(site, start, end)
    return filters.last_hours(site, hours)


def look_back(site: DataFrame, first, rows: int) -> DataFrame:
    """A range before ``first`` that holds the ``rows`` rows before it, or all there are.

    It reaches back a day, and as long as that is too few rows and older ones exist, four times as far. Each
    step counts rows of the day folders it reaches (see ``in_range``), so older folders are not read.
    """
    days = 1
    while True:
        start = first - timedelta(days=days)
        held = in_range(site, start, first, half_open=True)
        if held.count() >= rows or in_range(site, EARLIEST, start, half_open=True).isEmpty():
            return held
        days *= 4


def _score_slice(detector: AnomalyDetector, readings: DataFrame, site_id: str, start, end, hours: int, context: bool):
    """Scored rows of a slice; ``context`` also reads the rows before it, so none stays unscored."""
    rows = site_slice(readings, site_id, start, end, hours)
    if not context:
        return rows, detector.score_raw_readings(rows)
    first = rows.agg(F.min(TS).alias("t")).first()["t"]
    if first is None:
        return rows, detector.score_raw_readings(rows)
    before = look_back(filters.by_site(readings, site_id), first, LOOK_BACK_ROWS)
    scored = detector.score_raw_readings(filters.last_rows(before, LOOK_BACK_ROWS).unionByName(rows))
    return rows, scored.where(F.col(TS) >= F.lit(first))


def get_timeseries(
    readings: DataFrame,
    site_id: str = "home-01",
    start=None,
    end=None,
    hours: int = 24,
    rule: str | None = None,
    detector: AnomalyDetector | None = None,
    context: bool = False,
) -> DataFrame:
    """Points of a range, optionally resampled and overlaid with scores.

    Each point carries the totals of the whole answer: number of points, first
    and last timestamp and, with a detector, the number of anomalies.
    """
    order = list(ORDER)
    scored = None
    if rule is not None:
        rows = resample.resample_mean(site_slice(readings, site_id, start, end, hours), rule)
        rows = rows.withColumnRenamed("bucket", TS)
        order = [TS]
        if detector is not None:
            scored = detector.score_dataframe(build_feature_matrix(rows, order=tuple(order)))
    elif detector is not None:
        rows, scored = _score_slice(detector, readings, site_id, start, end, hours, context)
    else:
        rows = site_slice(readings, site_id, start, end, hours)
    points = rows.select(SITE, *order, POWER)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min(TS).alias("a"), F.max(TS).alias("b"))
    totals = {"total_points": whole.select("n").scalar(), "start": whole.select("a").scalar(), "end": whole.select("b").scalar()}
    if scored is not None:
        scored = durable(scored.select(SITE, *order, *joins.SCORE_COLUMNS), "scored")
        points = joins.overlay(points, scored, (SITE,), order)
        totals["anomaly_count"] = scored.agg(F.count_if("is_anomaly").alias("n")).scalar()
    return points.withColumns(totals)


def get_anomalies(
    readings: DataFrame,
    detector: AnomalyDetector,
    site_id: str = "home-01",
    start=None,
    end=None,
    hours: int = 24,
    top_n: int = 50,
    context: bool = False,
) -> DataFrame:
    """Worst anomalies of a range, rounded, with their number and the range read."""
    rows, scored = _score_slice(detector, readings, site_id, start, end, hours, context)
    scored = durable(scored.select(SITE, *ORDER, POWER, VOLTAGE, *joins.SCORE_COLUMNS), "scored")
    return ranking.anomaly_report(scored, rows, top_n)


def tool_anomalies(
    readings: DataFrame, detector: AnomalyDetector, start, end, top_n: int = 10, site_id: str = "home-01"
) -> DataFrame:
    """Worst anomalies of a range beside the counts of all scored rows."""
    scored = detector.score_raw_readings(in_range(filters.by_site(readings, site_id), start, end))
    scored = durable(scored.select(SITE, *ORDER, POWER, VOLTAGE, *joins.SCORE_COLUMNS), "scored")
    totals = batch_totals(scored)
    return ranking.get_anomalies(scored, top_n).select(
        minute_text().alias("timestamp"),
        half_up(POWER, 3).alias("power_kw"),
        half_up(VOLTAGE, 1).alias("voltage_v"),
        half_up("anomaly_score", 4).alias("anomaly_score"),
        totals.select("anomaly_count").scalar().alias("total_anomalies_in_range"),
        totals.select("total").scalar().alias("total_readings_in_range"),
        totals.select("anomaly_pct").scalar().alias("anomaly_rate"),
    )


def tool_timeseries(readings: DataFrame, start, end, rule: str | None = "1h", site_id: str = "home-01") -> DataFrame:
    """Up to 48 points of a range; without a rule the readings themselves."""
    rows = in_range(filters.by_site(readings, site_id), start, end)
    rows = rows.withColumn("bucket", F.col(TS)) if rule is None else resample.resample_mean(rows, rule)
    return ranking.first_buckets(rows)


def tool_statistics(readings: DataFrame, start, end, site_id: str = "home-01") -> DataFrame:
    return profile.statistics(in_range(filters.by_site(readings, site_id), start, end))


def tool_date_range(readings: DataFrame, site_id: str = "home-01") -> DataFrame:
    return profile.date_range(filters.by_site(readings, site_id))


def dashboard(
    readings: DataFrame,
    site_id: str,
    start_date: str,
    end_date: str,
    rule: str | None = "15min",
    detector: AnomalyDetector | None = None,
) -> dict[str, DataFrame]:
    """The tables behind the dashboard: cards, consumption, voltage, sub_meters and anomalies."""
    rows = filters.by_days(filters.by_site(readings, site_id), start_date, end_date)
    scored = None
    if detector is not None:
        scored = durable(detector.score_raw_readings(rows).select(SITE, *ORDER, POWER, VOLTAGE, *joins.SCORE_COLUMNS), "scored")
    tables = {"cards": profile.cards(rows, scored)}
    if rule is None:
        series = rows.select(SITE, F.col(TS).alias("bucket"), ID, POWER)
    else:
        series = resample.resample_mean_full(rows, rule).select(SITE, "bucket", POWER)
    if scored is None:
        tables["consumption"] = series.withColumn("is_marked", F.lit(False))
    elif rule is None:
        marks = scored.where("is_anomaly").select(SITE, F.col(TS).alias("bucket"), ID, F.lit(True).alias("_m"))
        tables["consumption"] = _marked(series, marks, [SITE, "bucket", ID])
    else:
        near = joins.nearest_buckets(scored.where("is_anomaly"), series, rule).select(SITE, "bucket")
        tables["consumption"] = _marked(series, near.withColumn("_m", F.lit(True)), [SITE, "bucket"])
    tables["voltage"] = resample.voltage_band(rows, rule)
    if rule is not None:
        tables["sub_meters"] = resample.submeter_stack(rows, rule)
    else:
        tables["sub_meters"] = rows.select(SITE, F.col(TS).alias("bucket"), *METRICS[4:]).unpivot(
            [SITE, "bucket"], METRICS[4:], "meter", "mean_wh"
        )
    if scored is not None:
        tables["anomalies"] = ranking.anomaly_table(scored)
    return tables


def _marked(series: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    joined = series.join(marks, on, "left")
    return joined.withColumn("is_marked", F.coalesce("_m", F.lit(False))).drop("_m")
