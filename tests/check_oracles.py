"""Run queries next to their DuckDB twins and compare rows, names, types and values.

usage: python tests/check_oracles.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(spark, con, sf, name, fn, sql) -> str:
    t0 = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only rows={len(rows)} spark={t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"FAIL columns spark={cols} duckdb={sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        want = KINDS.get(f.dataType.simpleString())
        if want and want != types[f.name]:
            return f"FAIL type of {f.name}: spark={f.dataType.simpleString()} duckdb={types[f.name]}"
    idx = [names.index(c) for c in cols]
    other = [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]
    t2 = time.time()
    a, b = Counter(rows), Counter(other)
    if a == b:
        return f"ok rows={len(rows)} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return (f"FAIL rows {len(rows)}/{len(other)} differ {sum((a - b).values())}/{sum((b - a).values())}\n"
            f"   {cols}\n   spark : {str(only_a)[:900]}\n   duckdb: {str(only_b)[:900]}")


if __name__ == "__main__":
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    import __spark_entry__ as E
    from corpusloom.session import local_session

    spark = local_session()
    con = connect(sf)
    oracles, bad = E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            res = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as e:  # report and go on
            res = f"FAIL {type(e).__name__}: {str(e)[:700]}"
        bad += res.startswith("FAIL")
        print(f"{name}: {res}", flush=True)
    print(f"{bad} failures")
