"""Spark queries against their SQL forms on the driver's small tables, and the contract of the entry module."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from cytoframe.plans import queries as base
from test_operators import open_moves

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", [n for n in base.SQL])
def test_query_equals_sql(spark, duck, name):
    df = base.QUERIES[name](spark, DATA)
    cursor = duck.execute(base.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["cell_id", "total", "n_genes", "max_count", "top_share"]
    assert df.count() == 150


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_louvain_query_leaves_no_move(spark):
    """no node of its communities gains by a move, and no community by entering another."""
    edges = [(r.i, r.j, r.w) for r in base._graph(spark, DATA).collect()]
    of = {r.node: r.label for r in base.QUERIES["c5_louvain"](spark, DATA).collect()}
    assert of.keys() == {v for i, j, _ in edges for v in (i, j)} and open_moves(edges, of) == ([], [])
