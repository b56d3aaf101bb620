"""Every registered query (but the training-data ones, which have their own tests) against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

from siltstone.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: ("nan" if math.isnan(x) else f"{x:.9g}") if isinstance(x, float) else str(x)
    return sorted(str([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows is not None
        return
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)
