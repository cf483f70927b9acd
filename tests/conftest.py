import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dayspell.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "dayspell-tests")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as dicts, ordered."""
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
