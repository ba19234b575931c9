"""The registry of queries over the driver tables: name -> query, and name -> DuckDB SQL."""

from __future__ import annotations

from dagstore.plans import alerting, objects, sources, state  # noqa: F401
from dagstore.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
