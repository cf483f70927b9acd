"""Every registered query with a SQL twin gives the same rows in DuckDB."""

import pytest
from conftest import DATA
from oracle import compare, connect

from dayspell.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    assert [p for p in compare(df, con, ORACLES[name]) if not p.startswith("note")] == []
