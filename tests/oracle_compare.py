"""Run queries beside their SQL in DuckDB and compare names, counts and values."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns {names} vs {sorted(found)}"
    at = [found.index(n) for n in names]
    other = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=_key)
    if len(mine) != len(other):
        return f"{len(mine)} rows vs {len(other)}"
    for a, b in zip(mine, other):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(names, a))} vs {dict(zip(names, b))}"
    if len(mine) == 0:
        return "no rows"
    return None


def main() -> None:
    from lakewarden.plans.registry import ORACLES, QUERIES
    from lakewarden.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", extra={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                problem = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}",
              flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
