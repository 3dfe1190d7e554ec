"""All registered queries."""

from siteval.plans import queries_corpus, queries_reports, queries_scores, queries_urls  # noqa: F401
from siteval.plans.registry import ORACLES, QUERIES, runnable

__all__ = ["ORACLES", "QUERIES", "runnable"]
