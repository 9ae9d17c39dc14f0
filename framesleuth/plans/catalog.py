"""All registered queries."""

from __future__ import annotations

from framesleuth.plans import comparison, evidence, gpu, ledgers, libraries, live, scores, selection, telemetries, timelines  # noqa: F401
from framesleuth.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
