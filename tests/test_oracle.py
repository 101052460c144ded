"""Every registered query against DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as driver
import oracle

SF_DIR = "/root/testdata/sf0.001"
ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_matches_oracle(spark, duck, name):
    result = driver.queries()[name](spark, SF_DIR)
    if name in ORACLE:
        assert oracle.compare(result, duck, ORACLE[name]) is None
    else:
        assert result.count() > 0


def test_entry_runs(spark):
    result = driver.entry(spark)
    assert result.columns == ["facet", "value", "n"]
    assert result.count() > 0
