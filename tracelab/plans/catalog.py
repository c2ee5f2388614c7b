"""Registry of every query plan (imports each plan module once)."""

from __future__ import annotations

from tracelab.plans import common
from tracelab.plans import core_plans, fit_plans, geometry_plans, run_plans, sae_plans, sampling_plans, stage_plans, stream_plans, text_plans  # noqa: F401  (registers plans)

flagship = sae_plans.flagship


def all_queries():
    return common.QUERIES


def all_sql():
    return common.ORACLE_SQL
