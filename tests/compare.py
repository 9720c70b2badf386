"""Runs registered queries next to their SQL in DuckDB and compares rows exactly.

    python -m tests.compare <folder> [name …]
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
         "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return connection


def _key(row):
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, float) else (True, "f", v) for v in row)


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")


def unwanted(df) -> list[str]:
    """Operators that no plan should hold."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in UNWANTED if name in plan]


def compare(df, connection, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    relation = connection.sql(sql)
    if names != sorted(relation.columns):
        return f"columns {names} != {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    other = {n: (KINDS.get(t, t), kinds[n]) for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]}
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    theirs = sorted(relation.project(", ".join(f'"{n}"' for n in names)).fetchall(), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b or list(map(repr, a)) != list(map(repr, b))]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, e.g. {names}: {different[0]}"
    return f"types {other}" if other else None


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import make_session
    spark = make_session()
    connection, sql, failed = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                result = compare(df, connection, sql[name]) or unwanted(df) or None
                verdict = "equal" if result is None else f"DIFFERENT: {result}"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR: {str(error).strip().splitlines()[0][:400]}"
        failed += not verdict.startswith(("equal", "rows"))
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
