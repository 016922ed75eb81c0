import pytest

from profilark.plans import registry
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    names, rows = spark_rows(registry.queries()[name](spark, small))
    want_names, want = sql_rows(small, registry.oracle_sql()[name])
    assert names == want_names
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, tiny, name):
    assert registry.queries()[name](spark, tiny).count() > 0
