"""Every registered query and, where DuckDB can express it, its SQL."""

from __future__ import annotations

from .jobs import blocks, brick_trees, carved, dumps, extras, fields, fronts, isosurface, relations, reshape, series, shapes, surface, topology, views  # noqa: F401  (they register their jobs)
from .jobs.common import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "contour_search"
