"""Run queries on Spark and their SQL on DuckDB and compare the results.

    python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tagloom.queries import ORACLES, QUERIES  # noqa: E402
from tagloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SIZES: dict[str, int] = {}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def shape(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=lambda r: tuple((v is None, str(v)) for v in r))
    return names, types, rows


def compare(con, spark, name: str, sf: str) -> str:
    """Empty when equal, else what differs."""
    got = shape(QUERIES[name](spark, sf).toArrow())
    SIZES[name] = len(got[2])
    if name not in ORACLES:
        return "" if got[2] else "no rows"
    want = shape(con.sql(ORACLES[name]).to_arrow_table())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        return f"types {got[1]} and {want[1]}"
    if len(got[2]) != len(want[2]):
        return f"{len(got[2])} and {len(want[2])} rows"
    different = [(a, b) for a, b in zip(got[2], want[2]) if a != b]
    return f"{len(different)} rows differ, first {different[0]}"[:600] if different else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            problem = compare(con, spark, name, args.sf)
        except Exception as error:  # noqa: BLE001  (report and go on)
            problem = f"{type(error).__name__}: {error}"[:900]
        failed += bool(problem)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.1f}s {name} [{SIZES.get(name)}] {problem}", flush=True)
    print(f"{failed} failed")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
