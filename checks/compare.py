"""Run registered queries beside their SQL: python -m checks.compare [sf] [name ...]"""

import sys
import tempfile
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "isoformat") else v)
    df = df.astype(object).where(df.notna(), None)
    return df.map(str).sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(set(spark_df.columns) ^ set(sql_df.columns))}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} and {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a.equals(b):
        return None
    wrong = (a != b).any(axis=1)
    cols = list(a.columns[(a != b).any(axis=0)])
    return f"{wrong.sum()} rows differ in {cols}\n{a[wrong].head(3)[cols].to_string()}\n{b[wrong].head(3)[cols].to_string()}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wattspan-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    sql, failed, total = oracle_sql(), [], 0.0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - started
            total += took
            result = "rows only" if name not in sql else difference(got, db.execute(sql[name]).df()) or "equal"
        except Exception as e:  # a broken query must not hide the others
            took, result = time.time() - started, f"ERROR {type(e).__name__}: {str(e)[:600]}"
            if len(sys.argv) > 2:
                traceback.print_exc()
        if result not in ("equal", "rows only"):
            failed.append(name)
        print(f"{name:22s} {took:6.2f}s {len(got) if 'got' in dir() else 0:7d} {result}", flush=True)
    print(f"total {total:.1f}s, failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
