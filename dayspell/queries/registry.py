"""Where queries register, and helpers that keep both sides of a check alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.queries import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; `uses` names the views its SQL starts from."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = views.with_views(uses, sql)
        return function

    return register


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0; SQL twins use round(x, digits) + 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(*[
        rounded(f"`{n}`", digits).alias(n) if t == "double" else F.col(f"`{n}`")
        for n, t in df.dtypes])
