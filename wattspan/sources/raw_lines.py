"""Raw meter lines: reading, parsing, bounds warnings and the bulk load."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.schema import BOUNDS, METRICS, RAW_METRICS, TS
from wattspan.sources.readings import append_readings

FIELD_COUNT = 2 + len(RAW_METRICS)

# The text forms accepted for a number and for a date with time.
_DIGITS = r"[0-9]+(_[0-9]+)*"
NUMBER = rf"^\s*[+-]?((({_DIGITS})(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
MOMENT = r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\s*$"
BLANKS = " \t\r\n\x0b\x0c"


def read_raw_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of one file or a folder of files, without their header lines."""
    return spark.read.text(path).where(~F.col("value").startswith("Date;Time;"))


def _number(text: Column) -> Column:
    plain = F.regexp_replace(F.btrim(text, F.lit(BLANKS)), "_", "")
    unsigned = F.regexp_replace(plain, "(?i)^[+-]?nan$", "NaN")
    return F.when(text.rlike(NUMBER), unsigned.try_cast("double"))


def _moment(text: Column) -> Column:
    part = [F.regexp_extract(text, MOMENT, i).try_cast("int") for i in range(1, 7)]
    day, month, year, hour, minute, second = part
    made = F.call_function("try_make_timestamp_ntz", year, month, day, hour, minute, second)
    return F.when((year >= 1) & (second < 60), made)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Split and type each line; adds ``status`` (ok, missing, invalid) and ``reason``.

    Checks run in a fixed order: field count, missing marker, date, numbers.
    Values and timestamp are present only on ok rows.
    """
    fields = F.split(F.btrim(F.col(value), F.lit(BLANKS)), ";", -1)
    df = lines.withColumn("_f", fields)
    moment_text = F.concat_ws(" ", F.get("_f", F.lit(0)), F.get("_f", F.lit(1)))
    typed = F.struct(
        _moment(moment_text).alias("ts"), F.transform(F.slice("_f", 3, len(RAW_METRICS)), _number).alias("values")
    )
    # a generated row is typed once, however many later filters and columns look at it
    df = df.withColumn("_typed", F.explode(F.array(typed)))
    at, values = F.col("_typed.ts"), F.col("_typed.values")
    first_bad = F.array_position(F.transform(values, lambda v: v.isNull()), True).cast("int")
    wrong_count = F.size("_f") != FIELD_COUNT
    unknown = F.array_contains("_f", "?")
    # fixed values: the texts of reasons, which users' logs are searched for
    reason = (
        F.when(wrong_count, F.concat(F.lit(f"Expected {FIELD_COUNT} fields, got "), F.size("_f")))
        .when(unknown, F.lit(None))
        .when(at.isNull(), F.concat(F.lit("Invalid date/time: "), moment_text))
        .when(first_bad > 0, F.concat(F.lit("Non-numeric metric value: '"), F.get("_f", first_bad + 1), F.lit("'")))
    )
    status = (
        F.when(wrong_count, "invalid")
        .when(unknown, "missing")
        .when(at.isNull() | (first_bad > 0), "invalid")
        .otherwise("ok")
    )
    ok = status == "ok"
    return df.select(
        *lines.columns,
        status.alias("status"),
        reason.alias("reason"),
        F.when(ok, at).alias(TS),
        *[F.when(ok, F.get(values, F.lit(i))).alias(m) for i, m in enumerate(RAW_METRICS)],
    )


def validate_metrics(names: dict[str, str] | None = None) -> Column:
    """Warnings for values outside the inclusive bounds; NaN is outside, null is skipped.

    ``names`` maps a metric to its column when they differ (table columns).
    """
    warnings = []
    for metric, (low, high) in BOUNDS.items():
        value = F.col((names or {}).get(metric, metric))
        # fixed value: the text of a warning
        text = F.concat(F.lit(f"{metric}="), value.cast("string"), F.lit(f" out of bounds [{low}, {high}]"))
        warnings.append(F.when((value < low) | (value > high) | F.isnan(value), text))
    return F.array_compact(F.array(*warnings))


def validate_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse and check bounds; ``warnings`` is empty on rows that are not ok."""
    return parse_lines(lines, value).withColumn("warnings", validate_metrics())


def to_readings(parsed: DataFrame) -> DataFrame:
    """The ok rows under their table names; a parsed NaN becomes null."""
    finite = [F.nanvl(F.col(raw), F.lit(None).cast("double")).alias(name) for raw, name in zip(RAW_METRICS, METRICS)]
    extra = [c for c in parsed.columns if c == "id"]
    return parsed.where(F.col("status") == "ok").select(*extra, TS, *finite)


def load_counters(validated: DataFrame) -> DataFrame:
    status = F.col("status")
    return validated.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(status == "ok").alias("inserted"),
        F.count_if(status == "missing").alias("skipped_missing"),
        F.count_if(status == "invalid").alias("skipped_invalid"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings"),
    )


def bulk_load(lines: DataFrame, table_path: str, site_id: str = "home-01", device_id: str = "meter-main") -> DataFrame:
    """Append every ok line to the readings table and return the load counters.

    Parsing is a pure function of the lines, so they are read once for the table and
    once for the counters, and no copy of them is written. Loading a file twice keeps
    both copies.
    """
    validated = validate_lines(lines)
    append_readings(to_readings(validated), table_path, site_id, device_id)
    return load_counters(validated)
