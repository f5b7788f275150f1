"""Sub-meter ratios, unmetered energy, display rounding and the daily load profile."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.functions.clock import as_col
from wattspan.schema import POWER, SUB_METERS, TS

RATIOS = ["sub_total_wh", "total_wh_per_min", "metered_ratio", "sub_1_share", "sub_2_share", "sub_3_share"]

# Relative load at each full hour 0..23.
WEEKDAY_LOAD = [
    0.15, 0.12, 0.10, 0.10, 0.10, 0.12, 0.25, 0.55, 0.70, 0.50, 0.35, 0.30,
    0.35, 0.40, 0.35, 0.30, 0.35, 0.55, 0.80, 0.90, 0.75, 0.55, 0.35, 0.20,
]
WEEKEND_LOAD = [
    0.15, 0.12, 0.10, 0.10, 0.10, 0.10, 0.15, 0.20, 0.35, 0.55, 0.60, 0.55,
    0.50, 0.45, 0.50, 0.55, 0.60, 0.65, 0.80, 0.85, 0.70, 0.50, 0.35, 0.20,
]


def wh_per_minute(power=POWER) -> Column:
    return as_col(power) * 1000 / 60


def submetering_ratios() -> dict[str, Column]:
    subs = [F.col(c) for c in SUB_METERS]
    total = subs[0] + subs[1] + subs[2]
    used = wh_per_minute()
    ratio = total / F.nullif(used, F.lit(0.0))
    # greatest/least skip nulls, so a missing ratio has to stay outside the clip
    clipped = F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.5)))
    out = {"sub_total_wh": total, "total_wh_per_min": used, "metered_ratio": clipped}
    for i, sub in enumerate(subs, start=1):
        out[f"sub_{i}_share"] = F.coalesce(sub / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return out


def add_submetering_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(submetering_ratios())


def unmetered_wh() -> Column:
    """Energy that no sub-meter saw, in Wh per minute, never negative."""
    rest = wh_per_minute() - F.col(SUB_METERS[0]) - F.col(SUB_METERS[1]) - F.col(SUB_METERS[2])
    return F.when(rest.isNotNull(), F.greatest(rest, F.lit(0.0)))


def half_up(x, digits: int) -> Column:
    """Rounding that is the same on every engine: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(as_col(x) * scale + 0.5) / scale


def load_multiplier(ts=TS) -> Column:
    """Relative load, linear between full hours; 23h runs into 0h of the same day's profile."""
    hour, minute = F.hour(ts), F.minute(ts)

    def interpolate(profile):
        levels = F.array(*[F.lit(v) for v in profile])
        here = F.element_at(levels, hour + 1)
        after = F.element_at(levels, F.pmod(hour + 1, F.lit(24)) + 1)
        return here + (after - here) * (minute / F.lit(60.0))

    return F.when(F.weekday(ts) >= 5, interpolate(WEEKEND_LOAD)).otherwise(interpolate(WEEKDAY_LOAD))
