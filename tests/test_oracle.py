"""Every query that SQL can express, against DuckDB on the same tables."""

import math

import duckdb
import pytest

from hueframe import queries

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v) if isinstance(v, (str, bool)) else v or 0) for v in r))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = ordered(df.select(names).collect()), ordered(cursor.fetchall())
    assert len(got) == len(want) and got
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, float) and isinstance(b, (int, float)) and a == pytest.approx(b, abs=2e-6) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_have_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
