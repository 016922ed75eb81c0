import pytest

from profilark.llm import queries as q
from tests.llm.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    assert spark_rows(q.queries()[name](spark, small)) == sql_rows(small, q.oracle_sql()[name])
