"""Run queries against their SQL in DuckDB: python -m verification.compare SF_DIR [name-prefix ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from verification.queries import ORACLES, QUERIES


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: df[c] for c in sorted(df.columns)})
    for c in out.columns:
        column = out[c]
        if pd.api.types.is_bool_dtype(column):
            column = column.astype(object).map(lambda x: "NULL" if pd.isna(x) else str(bool(x)))
        elif pd.api.types.is_numeric_dtype(column):
            column = column.astype("float64").map(lambda x: "NULL" if pd.isna(x) else repr(float(x) + 0.0))
        else:
            column = column.map(lambda x: "NULL" if x is None or x is pd.NaT or x is pd.NA or x != x else str(x)[:19].replace(" 00:00:00", "") if hasattr(x, "year") else str(x))
        out[c] = column
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def check(spark: SparkSession, con, sf: str, name: str) -> tuple[str, float]:
    started = time.time()
    got = QUERIES[name](spark, sf).toPandas()
    took = time.time() - started
    if name not in ORACLES:
        return f"rows only: {len(got)}", took
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} / {sorted(want.columns)}", took
    if len(got) != len(want):
        return f"FAIL rows {len(got)} / {len(want)}", took
    a, b = normal(got), normal(want)
    if a.equals(b):
        return f"ok {len(got)}", took
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    at = (a != b).any(axis=1).idxmax()
    return f"FAIL values in {bad}\n   {a.loc[at].to_dict()}\n   {b.loc[at].to_dict()}", took


def main() -> None:
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            text, took = check(spark, con, sf, name)
        except Exception as error:  # noqa: BLE001 - reported per query
            text, took = f"FAIL {type(error).__name__}: {str(error)[:900]}", 0.0
        failed += text.startswith("FAIL")
        print(f"{took:7.2f}s {name}: {text}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
