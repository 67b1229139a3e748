"""All engine queries by name, with their DuckDB oracles."""

from __future__ import annotations

from geolith.plans import relational, spatial_queries, stored

QUERIES: dict = spatial_queries.QUERIES | relational.QUERIES | stored.QUERIES
ORACLES: dict[str, str] = spatial_queries.ORACLES | relational.ORACLES | stored.ORACLES
FLAGSHIP = "spatial_flagship_agg"
