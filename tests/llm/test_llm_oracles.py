"""Registered queries against their SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from meterlens.llm.queries import llm_oracles, llm_queries

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def _plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else round(value, 9) if isinstance(value, float) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = llm_queries()[name](spark, sf_dir)
    cursor = duck.execute(llm_oracles()[name])
    assert _rows(result.columns, [tuple(r) for r in result.collect()]) == _rows(
        [c[0] for c in cursor.description], cursor.fetchall()
    )
