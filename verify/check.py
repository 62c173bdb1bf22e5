"""Run every registered query next to its oracle statement and report differences.

    python -m verify.check [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str, query, statement: str | None) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if statement is None:
        return True, f"{len(got)} rows (no oracle)"
    result = con.execute(statement)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(columns) ^ set(df.columns))}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    kinds = {c[0]: str(c[1]) for c in result.description}
    odd = [c for c, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k or "DATE" in k or "TIME" in k]
    if odd:
        return False, f"oracle types not plain: {[(c, kinds[c]) for c in odd]}"
    for g, w in zip(got, want):
        if g != w:
            cols = sorted(columns)
            bad = [(cols[i], g[i], w[i]) for i in range(len(cols)) if g[i] != w[i]]
            return False, f"first difference {bad[:4]} in {g[:6]}"
    return True, f"{len(got)} rows"


def main() -> int:
    sys.path.insert(0, ".")
    from basketry.session import local_session
    from verify.catalog import ORACLE, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    names = [n for n in QUERIES if n.startswith(prefixes)]
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir, QUERIES[name], ORACLE.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
