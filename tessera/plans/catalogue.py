"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from tessera.plans import ast, chunks, code, evaluation, files, graphs, joins, models, quality, records, relational, streams, texts, vectors, workflows  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
