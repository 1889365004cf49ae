"""Every registered query of the masking library against its DuckDB SQL at the smallest scale."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from maskframe.jobs import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    wanted = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cursor.fetchall())
    assert rows == wanted
