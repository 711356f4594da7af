"""Run registered queries on Spark and their SQL on DuckDB and compare the two results exactly."""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def rows_of(table: pa.Table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    rows = list(zip(*[c.to_pylist() for c in table.columns])) if names else []
    return names, [_kind(f.type) for f in table.schema], sorted(rows, key=repr)


def difference(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    """None when equal, else a short description of the first difference."""
    n1, t1, r1 = rows_of(spark_table)
    n2, t2, r2 = rows_of(duck_table)
    if n1 != n2:
        return f"columns {n1} != {n2}"
    if t1 != t2:
        return "types " + str([(n, a, b) for n, a, b in zip(n1, t1, t2) if a != b])
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}"
    for a, b in zip(r1, r2):
        if a != b:
            cols = [n for n, x, y in zip(n1, a, b) if x != y]
            return f"values differ in {cols}: {a} != {b}"
    return None


def run(names: list[str] | None, sf_dir: str) -> int:
    import __spark_entry__ as entry
    from creaseline.session import get_session

    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toArrow()
            spent = time.time() - start
            if name in sqls:
                why = difference(got, con.sql(sqls[name]).to_arrow_table())
            else:
                why = None if got.num_rows else "no rows"
            mark = "ok" if why is None else "DIFF"
            print(f"{mark:5} {name:40} rows={got.num_rows:7} {spent:6.2f}s {'' if name in sqls else '(rows only)'} {why or ''}"[:600], flush=True)
            failed += why is not None
        except Exception as e:  # report and go on with the next query
            failed += 1
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    sys.exit(1 if run(args or None, sf) else 0)
