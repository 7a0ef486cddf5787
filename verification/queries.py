"""All queries, by part."""

from verification import q_audit, q_errors, q_history, q_ingest, q_models, q_scoring  # noqa: F401
from verification.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
