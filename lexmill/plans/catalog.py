"""The registered queries of the reference's own operators and their DuckDB SQL."""

from __future__ import annotations

from lexmill.plans import documents, records, retrieval

QUERIES = documents.QUERIES | retrieval.QUERIES | records.QUERIES
ORACLES = documents.ORACLES | retrieval.ORACLES | records.ORACLES
