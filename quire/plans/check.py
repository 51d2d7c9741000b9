"""Local correctness check: Spark query vs its DuckDB twin.

Mirrors the driver's comparison: columns sorted by name, row count, column
types by family, and an order-insensitive hash over the row values.

    python -m quire.plans.check --sf-dir /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import hashlib
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for ln in lines:
        h.update(ln.encode("utf-8", "surrogatepass"))
        h.update(b"\n")
    return h.hexdigest(), lines


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name, fn, sql, sf_dir, con, show=3):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, why=f"columns {sorted(scols)} vs {sorted(dcols)}")
        return res
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    res["ok"] = hs == hd
    if not res["ok"]:
        only_s = sorted(set(ls) - set(ld))[:show]
        only_d = sorted(set(ld) - set(ls))[:show]
        res["why"] = f"spark-only {only_s!r}\n   duck-only {only_d!r}"
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    from quire.plans.registry import oracle_sql, queries
    from quire.session import local_session
    spark = local_session()
    con = duck_connect(a.sf_dir)
    qs, sq = queries(), oracle_sql()
    names = a.names or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], sq.get(n), a.sf_dir, con)
        except Exception as ex:  # report and continue with the next query
            r = {"name": n, "ok": False, "why": f"{type(ex).__name__}: {str(ex)[:400]}"}
        flag = {True: "OK  ", False: "FAIL", None: "ROWS"}[r.get("ok")]
        bad += r.get("ok") is False
        print(f"{flag} {n:28s} rows={r.get('rows')} oracle={r.get('oracle_rows')} "
              f"spark={r.get('spark_s')}s duck={r.get('duck_s')}s", flush=True)
        if r.get("why"):
            print("   ", r["why"], flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
