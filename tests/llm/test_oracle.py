import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_duckdb(name, same):
    same(QUERIES[name], ORACLE_SQL[name])
