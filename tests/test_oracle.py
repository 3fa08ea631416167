"""Every registered query runs; every query with SQL agrees with it, names and values."""

import pytest

import check
from contentlake import plans


@pytest.fixture(scope="module")
def con(folder):
    return check.duck(folder)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(name, spark, con, folder):
    result, _ = check.compare(spark, con, folder, name, plans.QUERIES[name], plans.ORACLE[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_runs(name, spark, folder):
    assert plans.QUERIES[name](spark, folder).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
