"""Named queries of the retrieval operators and the SQL that checks them."""

from __future__ import annotations

from corvane.plans import lexical, products, vector

QUERIES: dict = lexical.QUERIES | vector.QUERIES | products.QUERIES
ORACLE_SQL: dict[str, str] = lexical.ORACLE_SQL | vector.ORACLE_SQL | products.ORACLE_SQL
