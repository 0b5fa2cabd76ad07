"""All queries of the raster operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import agents, composites, develop, flows, pointwise, protocol, rasters  # noqa: F401
from .bridge import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "prj02_percentile_stretch"
