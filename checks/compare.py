"""Run a registered query and its SQL side by side."""

import math
import sys
import time

import duckdb

from checks.registry import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    t = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_sec = time.time() - t
    if name not in ORACLES:
        return True, f"{len(got)} rows, no sql, {spark_sec:.1f}s"
    t = time.time()
    rel = con.sql(ORACLES[name])
    want = rel.fetchall()
    note = f"{len(got)} rows, {spark_sec:.1f}s, sql {time.time() - t:.1f}s"
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
        return False, f"{note}; sql {len(b)} rows; spark only {len(only_a)}: {only_a[:3]}; sql only {len(only_b)}: {only_b[:3]}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    return True, f"{note} {[(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema.fields]}"


def main(sf_dir: str, names: list[str]) -> int:
    import checks.all_checks  # noqa: F401
    from checks.local import session

    spark, con, bad = session(), connect(sf_dir), 0
    for name in names or QUERIES:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next one
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
