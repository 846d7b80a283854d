"""Compare registered queries with their SQL in DuckDB: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def kind(dtype: str) -> str:
    d = dtype.lower()
    for k, words in {"float": ("double", "float", "decimal"), "int": ("int", "long"), "bool": ("bool",), "time": ("timestamp",), "date": ("date",)}.items():
        if any(w in d for w in words):
            return k
    return "str"


def canonical(frame: pd.DataFrame) -> list[tuple]:
    out = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("∅")
            elif isinstance(v, (int,)) or hasattr(v, "dtype") and v.dtype.kind in "iu":
                cells.append(str(int(v)))
            elif isinstance(v, float) or hasattr(v, "dtype"):
                cells.append(repr(float(v)))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def same_row(x: tuple, y: tuple) -> bool:
    """Equal cells; a number may differ by one unit of its sixth decimal.

    Spark rounds the decimal text of a double and DuckDB its binary value, so an exact
    half (a duration in microseconds over 26, say) can round either way.
    """

    def same_cell(a: str, b: str) -> bool:
        if a == b:
            return True
        try:
            return "." in a and "." in b and abs(float(a) - float(b)) <= 1.5e-6
        except ValueError:
            return False

    return all(same_cell(a, b) for a, b in zip(x, y))


def compare(spark, con, folder: str, name: str, func, sql: str | None) -> str:
    df = func(spark, folder)
    spark_kinds = {c: kind(t) for c, t in df.dtypes}
    got = df.toPandas()
    if sql is None:
        return f"rows {len(got)}" if len(got) else "EMPTY"
    rel = con.sql(sql)
    duck_kinds = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    want = rel.df()
    if spark_kinds != duck_kinds:
        diff = {c: (spark_kinds.get(c), duck_kinds.get(c)) for c in {*spark_kinds, *duck_kinds} if spark_kinds.get(c) != duck_kinds.get(c)}
        return f"SCHEMA {diff}"
    if len(got) != len(want):
        return f"ROWS spark {len(got)} duckdb {len(want)}"
    # pandas holds whole numbers beside missing ones as floats.
    whole = {c: "Int64" for c, k in spark_kinds.items() if k == "int"}
    a, b = canonical(got.astype(whole)), canonical(want.astype(whole))
    bad = [(x, y) for x, y in zip(a, b) if not same_row(x, y)]
    if bad:
        return f"VALUES {len(bad)} of {len(a)} differ, first {sorted(got.columns)}: {bad[0]}"
    return f"ok {len(a)}"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from glyco.session import builder

    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    folder = f"{DATA}/sf{sf}"
    spark = (
        builder(master="local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("HOT"):  # force every large-series, large-table and large-group path
        from glyco.session import LIMITS

        for name in LIMITS:
            spark.conf.set(name, os.environ["HOT"])
    con = connect(folder)
    oracle, failed = oracle_sql(), 0
    for name, func in queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, folder, name, func, oracle.get(name))
        except Exception as e:  # the check reports every query, also a broken one
            verdict = f"ERROR {type(e).__name__} {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad = not verdict.startswith(("ok", "rows"))
        failed += bad
        if verdict == "ok 0":
            verdict += "  <-- no rows"
        print(f"{'FAIL' if bad else '    '} {name:34s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
