"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from waymark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = plain(df.select(*columns).collect())
    assert mine
    if name in registry.SQL:
        got = duck.execute(registry.SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert mine == plain([tuple(r[i] for i in order) for r in got.fetchall()])
