"""Side-by-side check of registered queries against their reference SQL.

    python tests/compare.py [sf directory] [query,query,...]
"""

import glob
import os
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].astype(float)
        elif df[c].dtype.kind in "iub":
            df[c] = df[c].astype("float64" if df[c].isna().any() else "int64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(a, b):
    """None when equal, else a short description."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} against {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    a, b = canonical(a.copy()), canonical(b.copy())
    for c in a.columns:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        same = (x == y)
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            same |= np.isnan(x.astype(float)) & np.isnan(y.astype(float))
        if not same.all():
            i = int(np.argmin(same))
            return f"{c}: {int((~same).sum())} differ, first {x[i]!r} against {y[i]!r}"
    return None


def main():
    from meshtide.session import local_session, tables_freed
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2].split(",") if len(sys.argv) > 2 else list(entry.queries())
    spark, con = local_session(8), connect(sf)
    sql, bad, weak = entry.oracle_sql(), 0, []
    for name in want:
        t0 = time.time()
        try:
            with tables_freed():
                got = entry.queries()[name](spark, sf).toPandas()
            t1 = time.time()
            if name not in sql:
                weak.append(name)
                print(f"{name:28s} rows only {len(got):7d}  {t1 - t0:6.2f}s", flush=True)
                continue
            ref = con.execute(sql[name]).df()
            why = difference(got, ref)
            t2 = time.time()
        except Exception as e:  # report and go on
            m = str(e)
            why, t1, t2, got = f"ERROR {m[:300]}".replace("\n", " "), time.time(), time.time(), []
        bad += why is not None
        print(f"{name:28s} {'ok' if why is None else 'DIFF ' + why:s} {len(got):7d}  spark {t1 - t0:6.2f}s sql {t2 - t1:6.2f}s", flush=True)
    print(f"{bad} differ; rows only: {weak}")


if __name__ == "__main__":
    main()
