"""The driver contract."""

import __spark_entry__ as contract
from dayspell.queries import ORACLES, QUERIES


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert set(df.columns) == {"unit", "year", "records"} and df.count() > 0


def test_every_climate_query_has_a_sql_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())
