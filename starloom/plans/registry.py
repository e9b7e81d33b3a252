"""All named queries and their SQL counterparts."""

from __future__ import annotations

from starloom.plans import activation, archives, astro, catalogue, contracts, feeds, jobs, lookups, mosaic, projection, raster, rollups, scalars, status, streams, strings, texts, tiling

_MODULES = (rollups, feeds, mosaic, jobs, texts, astro, raster, archives, scalars, streams, contracts, lookups, strings, activation, status, tiling, catalogue, projection)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
