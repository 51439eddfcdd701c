"""Every registered query of the library against its DuckDB statement, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from evispan.plans import registry
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, (float, decimal.Decimal)):
            return None if math.isnan(x) else round(float(x), 6)
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda t: [(x is None, str(x)) for x in t]), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    got = rows_of(df.collect(), df.columns)
    assert got[0]
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name])
        assert got == rows_of(want.fetchall(), [d[0] for d in want.description])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["job_id", "selected", "spent", "steps"]
    assert set(e.oracle_sql()) <= set(e.queries())
