import math
import os

import duckdb
import pytest

import __spark_entry__

ENGINE = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def tables(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("name", ENGINE)
def test_query(spark, sf, tables, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    found = tables.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs) and all(same(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
