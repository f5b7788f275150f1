"""Calendar features, tariff labels, cyclical encodings and timestamp text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.schema import TS

# First hour of each tariff period.
TARIFF_STARTS = [
    (0, "off_peak"),
    (6, "morning_peak"),
    (9, "daytime"),
    (17, "evening_peak"),
    (21, "late_evening"),
]

CALENDAR = ["hour", "day_of_week", "month", "is_weekend"]
CYCLES = {"hour": ("hour", 24), "dow": ("day_of_week", 7), "month": ("month", 12)}
CYCLICAL = [f"{name}_{fn}" for name in CYCLES for fn in ("sin", "cos")]


def calendar_parts(ts=TS) -> dict[str, Column]:
    """Hour, weekday (Monday is 0), month and a 0/1 weekend flag."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


def time_of_use(hour: Column) -> Column:
    label = F.lit("unknown")
    for start, name in TARIFF_STARTS:
        label = F.when(hour >= start, name).otherwise(label)
    return label


def cyclical(parts: dict[str, Column]) -> dict[str, Column]:
    out = {}
    for name, (part, period) in CYCLES.items():
        angle = 2 * F.pi() * parts[part] / F.lit(float(period))
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def temporal(ts=TS) -> dict[str, Column]:
    parts = calendar_parts(ts)
    return {**parts, "time_of_use": time_of_use(parts["hour"]), **cyclical(parts)}


def add_temporal_features(df: DataFrame, ts: str = TS) -> DataFrame:
    return df.withColumns(temporal(ts))


def minute_text(ts=TS) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def iso_text(ts=TS) -> Column:
    """ISO-8601 text; microseconds appear only when there are any, as in Python."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", seconds).otherwise(F.concat_ws(".", seconds, fraction))
