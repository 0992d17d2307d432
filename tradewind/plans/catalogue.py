"""All queries: importing the plan modules registers them."""

from tradewind.plans import checks, decisions, diagnostics, economics, evidence, findings, gates, layers, ledger, lifecycle, marketing, marketplace, monitoring, operations, pilot, relational, reports, series, streams, texts, views  # noqa: F401
from tradewind.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
