"""Every query that SQL can express, against DuckDB on the smallest tables."""

import pytest

from lexigrid.plans import images, labelled, retrieval

QUERIES = {**retrieval.QUERIES, **labelled.QUERIES, **images.QUERIES}
SQL = {**retrieval.ORACLE_SQL, **labelled.ORACLE_SQL, **images.ORACLE_SQL}
#: Each costs DuckDB seconds at any size; their layers are compared in test_cnn.py.
SLOW = {"cnn_bn2", "cnn_relu2", "cnn_pool2", "cnn_flatten", "cnn_linear1", "cnn_linear2", "cnn_bn1", "cnn_pool1"}


@pytest.mark.parametrize("name", sorted(SQL.keys() - SLOW))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], SQL[name])


def test_sql_is_for_queries():
    assert SQL.keys() == QUERIES.keys()
