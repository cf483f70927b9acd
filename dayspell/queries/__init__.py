"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from dayspell.queries import heat, localday, monthly, pairs, qc, records, roundtrip, series, spatial, tables, text  # noqa: F401
from dayspell.queries.registry import ORACLES, QUERIES  # noqa: F401
