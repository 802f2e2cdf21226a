"""All registered queries."""
from veriledge.plans.catalog import (  # noqa: F401
    q_benchmark, q_jobs, q_ledger, q_policy, q_retrieval, q_scalars, q_sources, q_streams,
    q_tables,
)
from veriledge.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
