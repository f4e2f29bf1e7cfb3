"""Compare queries with their SQL twins: python tests/oracle_check.py [--sf DIR] [NAME_OR_PREFIX ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return float(f"{x:.9g}") if x != int(x) or abs(x) > 1e15 else int(x)
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if type(x).__name__ == "Decimal":
        return cell(float(x))
    if hasattr(x, "tzinfo") and x.tzinfo:
        return x.replace(tzinfo=None)
    return x


def views(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def compare(spark, con, folder, query, sql):
    """Empty text if equal, else what differs."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ of {len(got)}: {bad[:2]}" if bad else ""


def main(args):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = views(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, folder, query, sqls[name])
            else:
                n = query(spark, folder).count()
                why = "" if n else "no rows"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:700]}"
        failed += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - began:.1f}s {'' if name in sqls else '(rows only) '}{why}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
