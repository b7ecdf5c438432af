"""Registered queries over the test tables (see ``registry``)."""

from postlens.plans import q_explain, q_features, q_io, q_models, q_prepare, q_records, q_runs, q_sage, q_scoring  # noqa: F401  (registers queries)
from postlens.plans.registry import IDS, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "IDS"]
