"""The driver's contract, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    if os.path.isdir(SF):
        for t in TABLES:
            c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _names():
    from granary import registry

    return sorted(registry.queries())


@needs_data
@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, duck, name):
    from granary import registry

    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = duck.execute(sql)
    head = [d[0] for d in found.description]
    assert sorted(head) == sorted(df.columns)
    columns = sorted(head)
    ours = sorted([tuple(plain(r[c]) for c in columns) for r in rows], key=str)
    theirs = sorted([tuple(plain(dict(zip(head, r))[c]) for c in columns) for r in found.fetchall()], key=str)
    assert ours == theirs


@needs_data
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
