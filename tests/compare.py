"""Run queries beside their SQL equivalents and compare every value.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v if not isinstance(v, list) else tuple(_plain(x) for x in v)


def _kind(name: str) -> str:
    name = name.lower()
    for kind in ("bigint", "int", "double", "string", "boolean"):
        if name.startswith(kind):
            return kind
    return {"integer": "int", "varchar": "string"}.get(name, name)


def differences(spark, con, fn, sql: str, folder: str) -> list[str]:
    """Human-readable differences; none when both results are equal."""
    df = fn(spark, folder)
    names = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    types = {c[0]: str(c[1]) for c in rel.description}
    out = []
    if sorted(cols) != names:
        return [f"columns {names} vs {sorted(cols)}"]
    for c, t in df.dtypes:
        if _kind(t) != _kind(types[c]):
            out.append(f"type of {c}: {t} vs {types[c]}")
    at = [cols.index(c) for c in names]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if ours != theirs:
        a, b = ours - theirs, theirs - ours
        out.append(f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {sum(a.values())}, only theirs {sum(b.values())}")
        for side, rows in (("ours", a), ("theirs", b)):
            for row in list(rows)[:2]:
                out.append(f"  {side}: {str(dict(zip(names, row)))[:600]}")
    if not ours:
        out.append("no rows")
    return out


def main() -> int:
    import __spark_entry__ as e

    from proseforge.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql, failed = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            found = differences(spark, con, fn, sql[name], folder) if name in sql else (
                [] if fn(spark, folder).count() else ["no rows"])
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - began:.1f}s{'' if name in sql else ' (no sql)'}", flush=True)
        for line in found:
            print("    ", line, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
