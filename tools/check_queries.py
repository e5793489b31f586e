"""Run registered queries in Spark and their checking SQL in DuckDB and compare all rows.

usage: python tools/check_queries.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mxposture.plans import registry  # noqa: E402
from mxposture.plans.adapters import TABLES  # noqa: E402


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "~nan" if value != value else repr(round(value, 6) + 0.0)
    if hasattr(value, "tolist"):
        return canon(value.tolist())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        return True, f"{len(rows)} rows (no SQL)"
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    index = [names.index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in index) for r in cur.fetchall())
    if rows != want:
        diff = [(a, b) for a, b in zip(rows, want) if a != b][:2]
        only = sorted(set(rows) - set(want))[:2]
        other = sorted(set(want) - set(rows))[:2]
        return False, f"{len(rows)} vs {len(want)} rows; spark only {only}; sql only {other}; {diff[:0]}"
    return True, f"{len(rows)} rows equal"


def main() -> int:
    from mxposture import get_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = get_session(
        "check",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    con = duck(sf_dir)
    bad = 0
    for name in registry.QUERIES:
        if args[1:] and not any(name.startswith(p) for p in args[1:]):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as exc:  # report and go on with the other queries
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.2f}s  {note}", flush=True)
    spark.stop()
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
