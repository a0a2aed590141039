"""Command-line check: python -m tests.check [folder] [name ...]."""

import sys

from gaugework.session import ROWS_PER_SLICE, build_session
from tests.oracle import compare, connect


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sliced = bool(args) and args[0] == "--sliced"
    if sliced:
        args.pop(0)
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    if sliced:
        spark.conf.set(ROWS_PER_SLICE, "500")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            out = compare(spark, name, queries[name], sqls.get(name), folder, con)
        except Exception as error:
            out = {"rows": -1, "seconds": 0.0, "problem": "ERROR " + str(error)[:900]}
        mark = "R " if name not in sqls else "ok"
        if out["problem"]:
            mark, bad = "XX", bad + 1
        print(f"{mark} {name:28s} {out['rows']:7d} rows {out['seconds']:6.2f}s {out['problem'] or ''}", flush=True)
    print(f"{len(names)} queries, {bad} problems")


if __name__ == "__main__":
    main()
