"""Run the bound queries next to DuckDB on one data folder and report differences.

usage: python tools/check.py FOLDER [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tidewright.plans import REGISTRY  # noqa: E402
from tidewright.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if (v is None or v != v) else v for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v).__name__ in ("str",)), v if v is not None else 0)
                                            for v in r))


def compare(spark, con, q, folder) -> tuple[bool, str]:
    t0 = time.time()
    got = q.run(spark, folder).toPandas()
    t1 = time.time()
    spark.catalog.clearCache()
    if q.sql is None:
        return False, f"rows {len(got)} (no SQL to compare with) {t1 - t0:.1f}s"
    want = con.sql(q.sql).df()
    t2 = time.time()
    note = f"rows {len(got)} spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    a, b = canon(got), canon(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, first:\n   spark  {bad[0][0]}\n   duckdb {bad[0][1]}"
    empty = [c for c in got.columns if len(got) and got[c].isna().all()]
    return len(got) > 0, note + (f"  ALL NULL: {empty}" if empty else "")


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


if __name__ == "__main__":
    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name, q in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, q, folder)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(("ok   " if ok else "FAIL ") + name + "  " + note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
