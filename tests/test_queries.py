"""Every registered query against its SQL oracle on the smallest benchmark tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from meterlens.plans.oracles import all_oracles
from meterlens.plans.registry import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ORACLES = all_oracles()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=str)


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6) + 0.0
    return value


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"kmeans_groups", "silhouette_grid", "source_files"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    got = canonical(result.columns, [tuple(r) for r in result.collect()])
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert got == canonical(columns, cursor.fetchall())


def test_source_files(spark, sf_dir):
    names = {r["name"] for r in QUERIES["source_files"](spark, sf_dir).collect()}
    assert names == {f"{t}.parquet" for t in TABLES}


def test_entry(spark, sf_dir):
    assert entry_points.entry(spark).count() == 1
