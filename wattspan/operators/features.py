"""The complete feature matrix of a set of readings."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.functions.calendar import CALENDAR, CYCLICAL, temporal
from wattspan.functions.energy import RATIOS, submetering_ratios
from wattspan.operators.ordering import CHUNK_ROWS, SLOT_SECONDS
from wattspan.operators.windows import (
    LAGS,
    WINDOWS,
    add_rolling,
    check_labels,
    lag_columns,
    on_rows,
    rate_columns,
    rolling_names,
)
from wattspan.schema import DEVICE, ID, METRICS, ORDER, POWER, SITE, TS


IDENTITY = {ID, TS, SITE, DEVICE}


def feature_names(target_col: str = POWER, lags=LAGS, windows=WINDOWS) -> list[str]:
    """The numeric model features in training order: 7 metrics and 35 derived."""
    return [
        *METRICS,
        *CALENDAR,
        *CYCLICAL,
        *[f"{target_col}_lag_{k}m" for k in lags],
        *rolling_names(target_col, windows),
        f"{target_col}_diff_1m",
        f"{target_col}_diff_5m",
        f"{target_col}_pct_change_1m",
        *RATIOS,
    ]


def build_feature_matrix(
    df: DataFrame,
    target_col: str = POWER,
    drop_na: bool = True,
    keys=(SITE,),
    order=tuple(ORDER),
    lags=LAGS,
    windows=WINDOWS,
    chunk_rows: int = CHUNK_ROWS,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Temporal, lag, rolling, rate-of-change and sub-meter features of each reading.

    Two shuffles of the readings: by (key, time slot) to number them, by
    (key, chunk) for every row-based feature. Everything else is a projection.
    """
    check_labels(windows)

    def build(d, rows):
        looked_back = {**lag_columns(target_col, lags, rows), **rate_columns(target_col, rows)}
        d = d.withColumns(looked_back)
        # the rolling steps buffer whole rows; one packed field is copied faster than forty
        needed = [*keys, "_chunk", "_copied", "_rn"]
        packed = F.struct(*[c for c in d.columns if c not in needed]).alias("_row")
        d = d.select(*needed, packed, F.col(target_col).alias("_target"))
        d = add_rolling(d, "_target", list(windows), rows, drop_na)
        rolled = [F.col(a).alias(b) for a, b in zip(rolling_names("_target", windows), rolling_names(target_col, windows))]
        return d.select(*needed, "_row.*", *rolled)

    halo = max(max(windows) - 1, *lags, 5)
    out = on_rows(df, halo, build, keys, order, chunk_rows, slot_seconds)
    if drop_na:
        out = complete_rows(out, df.columns, target_col, lags)
    derived = [c for c in feature_names(target_col, lags, windows) if c not in METRICS]
    added = {**temporal(order[0]), **submetering_ratios()}
    return out.withColumns(added).select(*df.columns, "time_of_use", *derived)


def complete_rows(df: DataFrame, inputs, target_col: str, lags) -> DataFrame:
    """Keep rows without a null in any input or derived column.

    Only conditions that are not implied by others are tested: a calendar part
    is never null, a difference is null where its lag is, a share never is.
    """
    checked = [c for c in inputs if c not in IDENTITY]
    checked += [f"{target_col}_lag_{k}m" for k in lags]
    checked += [f"{target_col}_diff_5m", f"{target_col}_pct_change_1m"]
    present = [F.col(c).isNotNull() for c in checked]
    has_ratio = F.col(POWER) != 0
    return df.where(reduce(lambda a, b: a & b, [*present, has_ratio]))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column that is not part of the row's identity."""
    return df.dropna("any", subset=[c for c in df.columns if c not in IDENTITY])


def get_numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns in schema order, without identifiers and labels."""
    skip = {ID, "time_of_use"}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def require_features(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing features: {missing}")
