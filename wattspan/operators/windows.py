"""Lag, difference, rolling and gap features over the rows of a site."""

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattspan.functions import moments
from wattspan.functions.clock import micros
from wattspan.operators.ordering import CHUNK_ROWS, SLOT_SECONDS, chunk_window, number_rows, with_halo, without_halo
from wattspan.schema import METRICS, ORDER, POWER, SITE, TS

LAGS = (1, 5, 15, 60)
WINDOWS = (60, 360, 1440)

# More pieces mean more lags per step, fewer pieces more steps.
MAX_PIECES = 12
HELPER_GROWTH = 8


def rolling_label(width: int) -> str:
    return f"{width // 60}h" if width >= 60 else f"{width}m"


def check_labels(windows) -> None:
    labels = [rolling_label(w) for w in windows]
    if len(set(labels)) != len(labels):
        raise ValueError(f"windows {list(windows)} share a label: {labels}")


def rolling_names(target: str, windows) -> list[str]:
    return [f"{target}_roll_{s}_{rolling_label(w)}" for w in windows for s in ("mean", "std", "min", "max")]


def lag_columns(target: str, lags, rows: WindowSpec) -> dict[str, Column]:
    return {f"{target}_lag_{k}m": F.lag(target, k).over(rows) for k in lags}


def rate_columns(target: str, rows: WindowSpec) -> dict[str, Column]:
    value, previous = F.col(target), F.lag(target, 1).over(rows)
    return {
        f"{target}_diff_1m": value - previous,
        f"{target}_diff_5m": value - F.lag(target, 5).over(rows),
        f"{target}_pct_change_1m": (value - previous) / F.nullif(previous, F.lit(0.0)),
    }


def rolling_steps(windows) -> list[tuple[int, list[int]]]:
    """Each run length to build, in order, with the lengths of the runs it is made of.

    Wider windows reuse narrower ones (1440 rows are four runs of 360); helper
    lengths are added while a width would need many pieces.
    """
    known, steps = [1], []
    for width in sorted(set(windows)):
        pieces = _cover(width, known)
        while len(pieces) > MAX_PIECES:
            helper = max(s for s in known if s <= width) * HELPER_GROWTH
            if helper > width:
                break
            steps.append((helper, _cover(helper, known)))
            known.append(helper)
            pieces = _cover(width, known)
        if width not in known:
            steps.append((width, pieces))
            known.append(width)
    return steps


def _cover(width: int, known) -> list[int]:
    pieces, left = [], width
    for size in sorted(known, reverse=True):
        pieces += [size] * (left // size)
        left %= size
    return pieces


def add_rolling(
    df: DataFrame, target: str, windows, rows: WindowSpec, complete_only: bool = False
) -> DataFrame:
    """Rolling statistics whose cost per row does not grow with the width.

    The summary of the last ``width`` rows is the merge of a few shorter runs
    that end at this row and at earlier ones, fetched with ``lag``. All steps
    use the same window, so one shuffle and one sort serve every width.
    ``complete_only`` keeps the rows whose statistics are all present; it tests
    the counts, which is cheaper than testing the statistics.
    """
    check_labels(windows)
    kept = df.columns
    df = df.withColumn("_run_1", moments.single(F.col(target).cast("double")))
    steps = rolling_steps(windows)
    for i, (width, pieces) in enumerate(steps):
        used = {f"_run_{size}" for later, parts in steps[i:] for size in parts}
        wanted = used | {f"_run_{w}" for w in windows}
        df = df.select(*[c for c in df.columns if not c.startswith("_run_") or c in wanted])
        base, fetched, names, back = df.columns, [], [], 0
        for size in pieces:
            name = f"_run_{size}"
            if back:
                name = f"_part_{back}"
                fetched.append(F.lag(f"_run_{size}", back).over(rows).alias(name))
            names.append(name)
            back += size
        merged = f"_run_{width}"
        df = moments.merge(df.select("*", *fetched), names, merged).select(*base, merged)
    if complete_only:
        for w in windows:
            df = df.where(F.col(f"_run_{w}")["n"] >= max(w // 2, 2))
    named = [
        column.alias(f"{target}_roll_{stat}_{rolling_label(w)}")
        for w in windows
        for stat, column in moments.statistics(F.col(f"_run_{w}"), w // 2).items()
    ]
    return df.select(*kept, *named)


def on_rows(df: DataFrame, halo: int, build, keys=(SITE,), order=tuple(ORDER), chunk_rows: int = CHUNK_ROWS, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Run ``build(df, window)`` over chunked rows that can look back ``halo`` rows.

    A metric that is NaN counts as null. ``slot_seconds`` is the unit in which rows are numbered.
    """
    missing = F.lit(None).cast("double")
    numbers = {f.name: F.nanvl(F.col(f.name), missing) for f in df.schema if f.name in METRICS and isinstance(f.dataType, T.DoubleType)}
    numbered = number_rows(df.withColumns(numbers) if numbers else df, keys, order, slot_seconds, name="_rn")
    built = build(with_halo(numbered, halo, "_rn", chunk_rows), chunk_window(keys, "_rn"))
    return without_halo(built).drop("_rn")


def add_lag_features(df: DataFrame, target_col: str = POWER, lags=None, **options) -> DataFrame:
    lags = list(LAGS if lags is None else lags)
    return on_rows(df, max(lags), lambda d, rows: d.withColumns(lag_columns(target_col, lags, rows)), **options)


def add_rolling_features(df: DataFrame, target_col: str = POWER, windows=None, **options) -> DataFrame:
    windows = list(WINDOWS if windows is None else windows)
    check_labels(windows)
    return on_rows(df, max(windows) - 1, lambda d, rows: add_rolling(d, target_col, windows, rows), **options)


def add_rate_of_change(df: DataFrame, target_col: str = POWER, **options) -> DataFrame:
    return on_rows(df, 5, lambda d, rows: d.withColumns(rate_columns(target_col, rows)), **options)


def add_steps(df: DataFrame, **options) -> DataFrame:
    """Seconds since the previous reading and a flag for steps over one minute."""

    def build(d, rows):
        step = micros(TS) - micros(F.lag(TS, 1).over(rows))
        return d.withColumn("step_seconds", step / F.lit(1_000_000.0)).withColumn(
            "is_gap", F.coalesce(F.col("step_seconds") > 60, F.lit(False))
        )

    return on_rows(df, 1, build, **options)
