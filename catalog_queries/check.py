"""Compare registered queries with their SQL twins: python -m catalog_queries.check [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(df, sql: str, con) -> str | None:
    """None if columns and rows agree, else what differs."""
    ran = con.execute(sql)
    names = [d[0] for d in ran.description]
    want = _rows(names, ran.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = _rows(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            return f"spark {g!r:.400}\n   duck  {w!r:.400}"
    return None


def main() -> int:
    from catalog_queries import registry
    from shelfscope.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session("check", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name, q in registry().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf)
            if q.sql is None:
                verdict, n = "rows only", len(df.collect())
                verdict = f"rows only ({n})" if n else "NO ROWS"
            else:
                verdict = compare(df, q.sql, con) or "ok"
        except Exception as e:  # report and go on with the other queries
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed = not verdict.startswith(("ok", "rows only"))
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name:34s} {time.time() - start:6.2f}s  {verdict if verdict != 'ok' else ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
