"""Each registered query against its SQL, run by DuckDB over the same tables."""

import math
import os
from datetime import datetime

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def v(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x.isoformat() if isinstance(x, datetime) else x

    return [columns[i] for i in order], sorted(str([v(r[i]) for i in order]) for r in rows)


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), columns)
