"""Run registered queries in Spark and their SQL in DuckDB and compare: ``python tests/oracle_check.py SF_DIR [name ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("floodframe-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, (bool, int, str)):
        return v
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=lambda t: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in t))


def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, took, f"rows only: {len(got[1])}"
    started = time.time()
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    note = f"{len(got[1])} rows, duckdb {time.time() - started:.1f}s"
    if got == want:
        return True, took, note
    if got[0] != want[0]:
        return False, took, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        note += f" != {len(want[1])}"
    extra = [t for t in got[1] if t not in set(want[1])][:2]
    lack = [t for t in want[1] if t not in set(got[1])][:2]
    return False, took, f"{note}\n   columns {got[0]}\n   spark  {extra}\n   duckdb {lack}"


def main():
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sys.argv[1])
    oracle, bad, total = entry.oracle_sql(), [], 0.0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            ok, took, note = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, took, note = False, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        total += took
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed {bad}, {total:.0f}s")


if __name__ == "__main__":
    main()
