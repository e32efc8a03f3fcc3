"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from rootgrain.plans import cases, checks, derivations, documents, published, readings, references  # noqa: F401
from rootgrain.plans import queries as engine

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{round(value, 6):g}"
    return str(int(value)) if isinstance(value, int) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in engine.ORACLE:
        assert rows
        return
    result = duck.execute(engine.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    told = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert told == want
