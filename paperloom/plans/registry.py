"""All registered queries."""

from __future__ import annotations

from . import aggregates, graphs, joins, models, sequences, texts  # noqa: F401  they register themselves
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
