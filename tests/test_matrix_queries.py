"""The queries through SparkArray against their SQL."""

import pytest
from test_whole_queries import against_sql

from tesserine import matrix_queries


@pytest.mark.parametrize("name", [name for name, *_ in matrix_queries.ENTRIES])
def test_against_sql(spark, name):
    against_sql(spark, name)
