"""Run registered queries in Spark and their oracle in DuckDB, and compare whole results.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
# Arrow types that hold the same values are compared as one.
_SAME = {"int8": "int", "int16": "int", "int32": "int", "int64": "bigint",
         "large_string": "string"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canonical(table):
    names = sorted(table.column_names)
    kinds = {n: _SAME.get(str(table.schema.field(n).type), str(table.schema.field(n).type))
             for n in names}
    columns = [table.column(n).to_pylist() for n in names]

    def key(v):
        if isinstance(v, float):
            v = None if math.isnan(v) else v + 0.0
        return repr(v)

    rows = sorted(tuple(key(v) for v in row) for row in zip(*columns)) if names else []
    return names, kinds, rows


def compare(spark_df, oracle, allow_empty: bool = False) -> str | None:
    """None when equal, else what differs."""
    names_a, kinds_a, rows_a = _canonical(spark_df.toArrow())
    names_b, kinds_b, rows_b = _canonical(oracle)
    if names_a != names_b:
        return f"columns {names_a} != {names_b}"
    if kinds_a != kinds_b:
        return "types " + str({n: (kinds_a[n], kinds_b[n]) for n in names_a
                               if kinds_a[n] != kinds_b[n]})
    if len(rows_a) != len(rows_b):
        return f"row count {len(rows_a)} != {len(rows_b)}"
    if not rows_a and not allow_empty:
        return "no rows: nothing compared"
    bad = [(a, b) for a, b in zip(rows_a, rows_b) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]} ({names_a})"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from hearsay.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("oracle", "local[8]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con.sql(oracles[name]).to_arrow_table())
                verdict = problem or "ok"
            else:
                problem, verdict = None, f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            problem = verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - start:.2f}s {verdict}",
              flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
