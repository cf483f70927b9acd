"""What the driver finds of this package."""

import re

import __spark_entry__ as contract


def test_each_operator_has_one_query():
    numbers = sorted(int(m[1]) for name in contract.queries() if (m := re.match(r"op(\d+)_", name)))
    assert numbers == list(range(1, 11)) and "pipeline" in contract.queries()
    assert {n for n in contract.oracle_sql() if re.match(r"op\d+_", n)} == {"op3_weighted_mix", "op4_template_leaks", "op6_url_aliases"}
