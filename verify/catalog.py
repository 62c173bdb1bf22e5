"""All registered queries."""

from verify import q_core, q_reports, q_audit, q_metrics, q_sinks, q_contracts, q_incremental  # noqa: F401
from verify.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
