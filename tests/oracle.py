"""Rows of a Spark query and of its SQL, in a form that compares."""

from __future__ import annotations

import glob
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def ordered(rows) -> list[tuple]:
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


def compare(spark, con, sf_dir: str, function, sql: str) -> None:
    df = function(spark, sf_dir)
    columns = sorted(df.columns)
    own = ordered([r[c] for c in columns] for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == ordered([r[k] for k in at] for r in cursor.fetchall())
