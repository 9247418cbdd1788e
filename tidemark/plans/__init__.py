"""Registered queries and their DuckDB equivalents."""

from tidemark.plans import indicators, misc, probability, strategy, surface, trading, report  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
