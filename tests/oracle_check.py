"""Compare registered queries with their oracle SQL: names, row counts, values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return str(v)
    if type(v).__name__ == "Decimal":
        return repr(float(v)) if v != int(v) else str(int(v))
    return str(v)


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the difference."""
    df = build(spark, sf_dir)
    order = sorted(df.columns)
    ours = sorted(tuple(_cell(r[c]) for c in order) for r in df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != order:
        return f"columns {order} vs {sorted(names)}"
    index = [names.index(c) for c in order]
    theirs = sorted(tuple(_cell(r[i]) for i in index) for r in rel.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ {order}: {wrong[:3]}"
    return None


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from phenoweave.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, name, build, oracles[name], sf_dir)
            else:
                result = None if len(build(spark, sf_dir).collect()) >= 0 else "none"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {time.time() - start:6.1f}s {name}{'' if name in oracles else ' (rows only)'} {result or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
