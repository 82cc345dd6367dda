"""Run every query next to its SQL: python -m checks.compare [sf_dir] [query ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLES
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process connection with the test tables as views."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def in_order(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results, whatever their order of rows and columns."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got, want = in_order(got), in_order(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind == "M" or b.dtype.kind == "M":
            a, b = a.astype("datetime64[us]"), b.astype("datetime64[us]")
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            a, b = a.astype(float), b.astype(float)
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{(~same).sum()} values of {c}, first {a[at]!r} against {b[at]!r}"
        if a.dtype.kind != b.dtype.kind:
            return f"type of {c}: {got[c].dtype} against {want[c].dtype}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(sf_dir), 0
    for name in names or QUERIES:
        started = time.time()
        got = QUERIES[name](spark, sf_dir).toPandas()
        seconds = time.time() - started
        verdict = "rows only"
        if name in ORACLES:
            verdict = difference(got, con.execute(ORACLES[name]).df()) or "same"
            bad += verdict != "same"
        print(f"{name:24} {len(got):8} rows {seconds:7.2f} s  {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
