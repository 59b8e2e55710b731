"""Every query with SQL gives what the checking engine gives, on the smallest given tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from inkloom.plans import registry

SQL = registry.oracle_sql()


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        if isinstance(v, float):
            return str(int(v)) if math.isfinite(v) and v == int(v) else f"{v:.6f}"
        return str(v)

    return list(frame.columns), sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def engine(data):
    connection = duckdb.connect()
    for file in os.listdir(data):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{data}/{file}')")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, engine, name):
    assert canonical(registry.queries()[name](spark, data).toPandas()) == canonical(engine.execute(SQL[name]).df())


#: Queries without SQL that find nothing in the smallest tables; fixtures have their cases.
EMPTY = {"j9_near_all", "v8_targets", "v11_excluded"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, data, name):
    found = registry.queries()[name](spark, data)
    assert (found.count() > 0) == (name not in EMPTY) and len(set(found.columns)) == len(found.columns)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
