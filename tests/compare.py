"""Run registered queries on Spark and DuckDB and compare whole results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else "-0.0" if v == 0 and math.copysign(1, v) < 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if type(v).__name__ in ("int64", "int32", "bool_"):
        return v.item()
    return v


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def key(row):
    return tuple((v is None, str(kind(v)), f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def compare(df, con, sql):
    """(ok, message) for one query."""
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        kinds = [({kind(r[i]) for r in got if r[i] is not None}, {kind(r[i]) for r in want if r[i] is not None}) for i in range(len(cols))]
        odd = [(cols[i], a, b) for i, (a, b) in enumerate(kinds) if a != b]
        return (not odd), (f"types differ {odd}" if odd else f"{len(got)} rows")
    bad = [(g, x) for g, x in zip(got, want) if g != x]
    diffs = []
    for g, x in bad[:3]:
        diffs.append([(c, a, b) for c, a, b in zip(cols, g, x) if a != b][:4] + [g[:3]])
    return False, f"{len(bad)} of {len(got)} rows differ: {diffs}"


def main(argv):
    from tapeline.registry import all_queries, run
    from tapeline.plans.checks import with_views
    from tapeline.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf, argv = argv[0], argv[1:]
    qs = all_queries()
    names = [n for n in qs if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    spark = local_session()
    con = duck(sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = run(n, spark, sf)
            if qs[n].sql is None:
                cnt = df.count()
                ok, msg = cnt > 0, f"{cnt} rows (no SQL)"
                t1 = time.time()
            else:
                ok, msg = compare(df, con, with_views(qs[n].sql))
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:32s} {time.time()-t0:6.2f}s {msg}", flush=True)
    print(f"{len(names)-bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
