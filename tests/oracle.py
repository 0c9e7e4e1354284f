"""Runs a query and its SQL on the same tables."""

import glob
import os

import duckdb


def rows(table: list[dict]) -> list[str]:
    return sorted(repr({k: round(v, 6) if isinstance(v, float) else v for k, v in sorted(r.items())}) for r in table)


def expected(sql: str, sf_dir: str) -> list[dict]:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def assert_same(df, sql: str, sf_dir: str) -> None:
    assert rows(df.toArrow().to_pylist()) == rows(expected(sql, sf_dir))
