"""All core queries by name, with their SQL counterparts."""

from __future__ import annotations

from lodestrata.plans import aggregates, code, evaluation, io, joins, quality, records, sampling, streams  # noqa: F401
from lodestrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
