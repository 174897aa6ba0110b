"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py SF_DIR [name ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(table):
    cols = sorted(table.column_names)
    data = table.select(cols).to_pydict()
    norm = lambda v: repr(float(v)) if isinstance(v, float) else repr(v)
    return cols, sorted(tuple(norm(v) for v in r) for r in zip(*[data[c] for c in cols]))


def compare(spark, con, name, fn, sql, sf):
    """``(ok, message)``."""
    got = fn(spark, sf).toArrow()
    if sql is None:
        return True, f"{got.num_rows} rows, no SQL"
    want = con.execute(sql).to_arrow_table()
    gc, gr = rows(got)
    wc, wr = rows(want)
    if gc != wc:
        return False, f"columns {gc} != {wc}"
    types = [f"{c}: {got.schema.field(c).type} / {want.schema.field(c).type}" for c in gc
             if str(got.schema.field(c).type).replace("large_", "") != str(want.schema.field(c).type).replace("large_", "")]
    if gr != wr:
        a, b = set(gr), set(wr)
        return False, f"rows {len(gr)} / {len(wr)}; only spark {list(a - b)[:3]}; only sql {list(b - a)[:3]} types {types}"
    return not types, f"{len(gr)} rows" + (f" TYPES {types}" if types else "")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from linkloom.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8, memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for n in names or qs:
        t = time.time()
        try:
            ok, msg = compare(spark, con, n, qs[n], sqls.get(n), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok ' if ok else 'BAD'} {n:32s} {time.time() - t:6.2f}s {msg}", flush=True)
        if not ok:
            bad.append(n)
    print(len(bad), "bad:", bad)
