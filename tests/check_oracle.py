"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def normal(rows):
    def cell(v):
        return (v is None, 0.0 + v if isinstance(v, float) else v)

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


def compare(spark, con, folder: str, query, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    result = con.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    theirs = result.fetchall()
    if sorted(kinds) != cols:
        return f"columns {cols} / {sorted(kinds)}"
    order = [list(kinds).index(c) for c in cols]
    theirs = normal(tuple(r[i] for i in order) for r in theirs)
    ours = normal(tuple(r) for r in df.select(*cols).collect())
    if dict(df.dtypes) != kinds:
        return f"types {dict(df.dtypes)} / {kinds}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ: {bad[0]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from fieldpulse.session import build_session

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, folder, query, sqls[name])
                note = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                note = f"{len(query(spark, folder).collect())} rows (no SQL)"
        except Exception as e:  # report and go on with the next query
            note = "FAILED " + str(e)[:1500]
        failed += note.startswith(("DIFF", "FAIL"))
        print(f"{time.time() - start:7.2f}s  {name:28s} {note}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
