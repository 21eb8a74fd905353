"""Every registered query of the engine against DuckDB on sf0.001."""

import pytest
from conftest import DATA

from lamina.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, same_as_duckdb, name):
    sf_dir = f"{DATA}/sf0.001"
    same_as_duckdb(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
