"""Imports every query module so the registry is complete."""

from __future__ import annotations

from claimlens.plans import q_analysis, q_explore, q_metrics, q_misc, q_models, q_retrieval, q_risk, q_stream  # noqa: F401
from claimlens.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
