"""Runs a query beside its SQL in DuckDB and compares the rows without their order."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted((DATA / sf).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return db


def rows(frame) -> list[str]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


def check(spark, query, sql: str, sf: str = "sf0.001") -> None:
    got, expected = query(spark, str(DATA / sf)).toPandas(), connect(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
