"""Queries with SQL of their own against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest
from seriesmill.llm.queries import ORACLE, QUERIES


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    base = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for f in os.listdir(base):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{base}/{f}'")
    rel = con.sql(ORACLE[name])
    df = QUERIES[name](spark, base)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = Counter(map(plain, rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    got = Counter(map(plain, df.select(*columns).collect()))
    assert got == want
