"""The queries of this subpackage that SQL can express, against DuckDB; those that it cannot have brute-force tests beside this file."""

import pytest

from lexigrid.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
