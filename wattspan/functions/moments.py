"""Mergeable summary of a run of values: count, mean, M2, min and max.

Summaries of adjacent runs combine around their common mean (the update of
Chan, Golub and LeVeque), which does not cancel the way differences of running
sums do.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single(value: Column) -> Column:
    """Summary of one value; a null value is an empty run."""
    seen = value.isNotNull()
    return F.struct(
        F.when(seen, 1.0).otherwise(0.0).alias("n"),
        F.coalesce(value, F.lit(0.0)).alias("mean"),
        F.lit(0.0).alias("m2"),
        value.alias("lo"),
        value.alias("hi"),
    )


def merge(df: DataFrame, runs: list[str], name: str) -> DataFrame:
    """Add ``name``, the summary of several adjacent runs; a null run is an empty one.

    Done in steps so that the common mean is computed once.
    """

    def total(term: str) -> str:
        return " + ".join("coalesce({}, 0D)".format(term.replace("run.", r + ".")) for r in runs)

    def extreme(pick: str, field: str) -> str:
        fields = ", ".join(f"{r}.{field}" for r in runs)
        return f"{pick}({fields})" if len(runs) > 1 else fields

    # counts are whole numbers, so the guard only ever replaces 0 by 1
    return (
        df.selectExpr("*", f"{total('run.n')} AS _n", f"{total('run.n * run.mean')} AS _total")
        .selectExpr("*", "_total / greatest(_n, 1D) AS _mean")
        .selectExpr(
            "*",
            "named_struct('n', _n, 'mean', _mean, "
            f"'m2', {total('run.m2 + run.n * (run.mean - _mean) * (run.mean - _mean)')}, "
            f"'lo', {extreme('least', 'lo')}, 'hi', {extreme('greatest', 'hi')}) AS {name}",
        )
        .drop("_n", "_total", "_mean")
    )


def statistics(run: Column, min_count: int) -> dict[str, Column]:
    """Mean, sample deviation, min and max; null below ``min_count`` values."""
    enough = run["n"] >= max(min_count, 1)
    spread = F.sqrt(run["m2"] / F.greatest(run["n"] - 1, F.lit(1.0)))
    return {
        "mean": F.when(enough, run["mean"]),
        "std": F.when(enough & (run["n"] >= 2), spread),
        "min": F.when(enough, run["lo"]),
        "max": F.when(enough, run["hi"]),
    }
