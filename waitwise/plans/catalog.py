"""The query catalogue: importing this module registers every query."""

from __future__ import annotations

from waitwise.plans import q_diag, q_logs, q_markov, q_misc, q_reports, q_series, q_stats  # noqa: F401
from waitwise.plans.registry import ORACLES, QUERIES, SECTIONS

__all__ = ["QUERIES", "ORACLES", "SECTIONS"]
