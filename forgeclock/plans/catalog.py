"""All registered queries and their oracles."""

from __future__ import annotations

from forgeclock.plans import catalog_ab, catalog_cd, catalog_efg, catalog_i, catalog_j

QUERIES = {}
ORACLES = {}
for _module in (catalog_ab, catalog_cd, catalog_efg, catalog_i, catalog_j):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
