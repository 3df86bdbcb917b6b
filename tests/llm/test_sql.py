"""Queries of this package beside their SQL."""

import pytest
from compare import connect, differences

from proseforge.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(spark, connect(folder), QUERIES[name], SQL[name], folder) == []
