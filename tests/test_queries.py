import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import graph_queries
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == float:
            df[c] = df[c].round(5) + 0.0
    return sorted(map(tuple, df.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(graph_queries.SQL))
def test_matches_sql(spark, duck, name):
    assert canonical(graph_queries.QUERIES[name](spark, DATA).toPandas()) == canonical(duck.execute(graph_queries.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
