"""Run every registered query next to its SQL twin and report differences.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def twin(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _key(row: tuple) -> str:
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def differences(spark_rows: list, spark_names: list[str], sql_rows: list, sql_names: list[str]) -> list[str]:
    if sorted(spark_names) != sorted(sql_names):
        return [f"columns {sorted(spark_names)} against {sorted(sql_names)}"]
    if len(spark_rows) != len(sql_rows):
        return [f"{len(spark_rows)} rows against {len(sql_rows)}"]
    order = sorted(spark_names)
    left = sorted((tuple(r[spark_names.index(c)] for c in order) for r in spark_rows), key=_key)
    right = sorted((tuple(r[sql_names.index(c)] for c in order) for r in sql_rows), key=_key)
    out = []
    for a, b in zip(left, right, strict=True):
        for name, x, y in zip(order, a, b, strict=True):
            if not _same(x, y):
                out.append(f"{name}: {str(x)[:200]!r} against {str(y)[:200]!r}")
    return out


def check(spark, connection, name: str, build, sql: str, sf_dir: str) -> list[str]:
    frame = build(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    return differences(rows, frame.columns, answer.fetchall(), names)


def main() -> None:
    import __spark_entry__ as entry
    from callgauge.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    connection = twin(sf_dir)
    oracle = entry.oracle_sql()
    wanted = sys.argv[2:] or list(entry.queries())
    for name in wanted:
        build = entry.queries()[name]
        start = time.time()
        try:
            if name not in oracle:
                print(f"{name:24} rows only: {build(spark, sf_dir).count()}", flush=True)
                continue
            found = check(spark, connection, name, build, oracle[name], sf_dir)
            print(f"{name:24} {'ok' if not found else 'DIFFERENT'} {time.time() - start:.2f}s", flush=True)
            for line in found[:4]:
                print("   ", line)
        except Exception as error:  # noqa: BLE001
            print(f"{name:24} FAILED {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
