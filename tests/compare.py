"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tickerloom.plans.views import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


#: Whole number columns whose result is defined to have nulls; a root has no parent.
GAPS = {"parent_conv_id"}


def compare(spark, con, folder, name, plan, sql):
    """(same, message) for one query."""
    frame = plan(spark, folder)
    collected = [tuple(r) for r in frame.collect()]
    left = _rows(frame.columns, collected)
    if sql is None:
        return True, f"{len(left)} rows (no SQL)"
    for i, (column, kind) in enumerate(frame.dtypes):
        # Data-frame libraries turn a whole number column with gaps into floats.
        if kind in ("int", "bigint", "smallint") and column not in GAPS and any(r[i] is None for r in collected):
            return False, f"whole number column {column} has nulls"
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    right = _rows(columns, found.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    if left == right:
        return True, f"{len(left)} rows"
    bad = [(a, b) for a, b in zip(left, right, strict=False) if a != b][:2]
    return False, f"{len(left)} vs {len(right)} rows; first differences {str(bad)[:900]}"


def main(prefixes: list[str]) -> None:
    import __spark_entry__ as entry
    from tickerloom.session import local_session

    folder = "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, plan in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            same, message = compare(spark, con, folder, name, plan, oracles.get(name))
        except Exception as exc:  # noqa: BLE001
            same, message = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += not same
        print("ok  " if same else "FAIL", name, message, f"{time.time() - start:.1f}s", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
