"""Run queries beside their SQL: python tests/compare.py SF_DIR [NAME...]; prints what differs and the seconds."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def same(spark, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    import duckdb

    began = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    names = df.columns
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f} s"
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(theirs_names):
        return False, f"columns {sorted(names)} and {sorted(theirs_names)}"
    order, order2 = sorted(range(len(names)), key=lambda i: names[i]), sorted(range(len(names)), key=lambda i: theirs_names[i])

    def norm(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(norm, v)) + "]"
        return "~" if v is None else str(v)

    a = sorted(tuple(norm(r[i]) for i in order) for r in rows)
    b = sorted(tuple(norm(r[i]) for i in order2) for r in theirs)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
    return True, f"{len(rows)} rows, {took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tessera.session import session

    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or q:
        matching = [n for n in q if n == name or (name.endswith("*") and n.startswith(name[:-1]))]
        for n in matching:
            try:
                ok, what = same(spark, n, q[n], o.get(n), sys.argv[1])
            except Exception as x:  # noqa: BLE001
                ok, what = False, f"{type(x).__name__}: {str(x)[:1500]}"
            bad += not ok
            print("ok  " if ok else "BAD ", n, what, flush=True)
    sys.exit(bool(bad))
