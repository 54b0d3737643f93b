"""Run registered queries beside their SQL and compare values.

    python -m tests.oracle_check [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, directory: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, directory)
    got = df.collect()
    t1 = time.time()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no SQL) {types}"
    cur = connect(directory).execute(sql)
    cols = [d[0] for d in cur.description]
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    head = f"rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(cols, want)
    if gc != wc:
        return False, f"{head} columns differ: {gc} != {wc}"
    loose = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",),
             "boolean": ("BOOLEAN",), "date": ("DATE",), "timestamp_ntz": ("TIMESTAMP",)}
    bad = [f"{c}:{types[c]}/{duck_types[c]}" for c in types if duck_types[c] not in loose.get(types[c], ())]
    note = f" TYPES {bad}" if bad else ""
    if gr == wr:
        return not bad, head + note
    diff = [(g, w) for g, w in zip(gr, wr) if g != w]
    return False, f"{head}{note} VALUES differ spark={len(gr)} duck={len(wr)} cols={gc}\n   first: {diff[:2] if diff else (gr[-1:], wr[-1:])}"[:3000]


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv or queries:
        try:
            ok, msg = compare(spark, f"/root/testdata/sf{sf}", name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {msg}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
