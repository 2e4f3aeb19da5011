"""Importing this module registers every query."""

from vulnlake.plans.registry import ORACLES, QUERIES
from vulnlake.plans import q_checks, q_findings, q_graph, q_links, q_live, q_scores, q_source, q_text  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
