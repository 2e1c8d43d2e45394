"""python tests/compare.py SF NAME...: runs registered queries beside their SQL in DuckDB and compares the rows as the driver does."""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings memory_rows memory_vectors memory_raw captions segments videos eval_items roster".split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def same(df, con, sql):
    """('', rows) when equal, else what differs."""
    got = [r.asDict(recursive=True) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} and {sorted(cols)}", len(got)
    key = lambda r: repr([plain(r[c]) for c in sorted(cols)])
    a, b = sorted(map(key, got)), sorted(map(key, want))
    if a == b:
        return "", len(got)
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return f"{len(a)} and {len(b)} rows; only here {list((x - y).elements())[:3]}; only in SQL {list((y - x).elements())[:3]}", len(got)


if __name__ == "__main__":
    import __spark_entry__ as e
    from tidemark.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = duck(folder), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or list(qs):
        t = time.time()
        try:
            if name in sql:
                why, n = same(qs[name](spark, folder), con, sql[name])
            else:
                why, n = "", qs[name](spark, folder).count()
        except Exception as x:  # noqa: BLE001
            why, n = f"{type(x).__name__}: {str(x)[:1500]}", -1
        print(f"{name}: {'OK' if not why else 'DIFFERS ' + why} ({n} rows, {time.time() - t:.1f} s{'' if name in sql else ', no SQL'})", flush=True)
