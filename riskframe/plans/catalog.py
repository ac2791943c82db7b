"""All queries on the given tables with their SQL counterparts."""

from __future__ import annotations

from riskframe.plans import catalog_data, catalog_drift, catalog_model, catalog_prep, catalog_score, catalog_split

PARTS = (catalog_data, catalog_split, catalog_prep, catalog_model, catalog_score, catalog_drift)

QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in PARTS for name, text in part.ORACLES.items()}
