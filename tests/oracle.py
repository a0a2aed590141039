"""Runs a registered query and its SQL on the same tables and compares them."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, name, run, sql, folder, con):
    start = time.time()
    df = run(spark, folder)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return {"rows": len(rows), "seconds": seconds, "problem": None}
    names = sorted(df.columns)
    result = con.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    fetched = result.fetchall()
    problem = None
    if sorted(described) != names:
        problem = f"columns {names} vs {sorted(described)}"
    else:
        positions = [list(described).index(n) for n in names]
        want = sorted(([_cell(r[i]) for i in positions] for r in fetched), key=_key)
        have = sorted(([_cell(r[n]) for n in names] for r in rows), key=_key)
        if len(want) != len(have):
            problem = f"rows {len(have)} vs {len(want)}"
        else:
            different = [(h, w) for h, w in zip(have, want) if h != w]
            if different:
                problem = f"{len(different)} rows differ, e.g. {different[0]}"
        types = dict(df.dtypes)
        odd = {
            n: (types[n], described[n])
            for n in names
            if SPARK_TO_DUCK.get(types[n]) != described[n]
        }
        if odd and problem is None:
            problem = f"types {odd}"
    return {"rows": len(rows), "seconds": seconds, "problem": problem}
