"""Every registered query runs at the smallest scale and equals its DuckDB twin."""

import __spark_entry__ as entry
import pytest
from check_oracle import compare, connect

from hybridq.workload import registry

entry.queries()  # registers; the training-data queries have tests of their own
QUERIES = {name: entry.queries()[name] for name in registry.QUERIES}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    ok, info = compare(spark, duck, name, QUERIES[name], ORACLE.get(name), sf)
    assert ok in (True, None), info


def test_entry(spark):
    df = entry.entry(spark)
    assert {"query_id", "rank", "id", "score"} <= set(df.columns)
    assert df.count() > 0
