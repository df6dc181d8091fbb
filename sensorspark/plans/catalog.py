"""All of the engine's queries and their SQL twins."""

from __future__ import annotations

from . import aggregates, alignment, analysis, rasters, registry, scalars, scans, sinks, smoothing, streams  # noqa: F401  (modules register their queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)
