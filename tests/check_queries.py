"""Compare registered queries with their SQL: ``python tests/check_queries.py [-s SF] [name-part ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

ROOT = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()  # fmt: skip


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> list[str]:
    """Problems found, empty if the query and its SQL agree."""
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return [] if df.columns else ["no columns"]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = [str(d[1]) for d in cursor.description]
    want = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} but SQL {sorted(names)}"]
    for field in df.schema:
        kind = kinds[names.index(field.name)]
        mine = field.dataType.simpleString()
        if SAME_TYPE.get(mine) != kind:
            problems.append(f"type of {field.name}: {mine} but SQL {kind}")
    mine, theirs = rows_of(df.columns, got), rows_of(names, want)
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows but SQL {len(theirs)}")
    elif mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        problems.append(f"{len(bad)} of {len(mine)} rows differ, e.g. {bad[0]}"[:1500])
    if not got:
        problems.append("no rows")
    return problems


def main() -> int:
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = "0.01"
    if "-s" in args:
        i = args.index("-s")
        sf = args[i + 1]
        del args[i : i + 2]
    folder = f"{ROOT}/sf{sf}"
    if "--plain" in args:  # a session without any settings of ours
        from pyspark.sql import SparkSession

        args.remove("--plain")
        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = make_session()
    con, checks, failed = connect(folder), oracle_sql(), []
    for name, q in queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            problems = compare(spark, con, folder, name, q, checks.get(name))
        except Exception as e:  # report and go on
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        note = "" if name in checks else " (no SQL)"
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{note}", *problems, sep="\n     " if problems else "", flush=True)
        if problems:
            failed.append(name)
    print(f"{len(failed)} failed", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    sys.exit(main())
