"""All queries of the core, and their SQL."""

from __future__ import annotations

from tallyloom.plans import cooccurrence_queries, feature_queries, label_queries, large, similarity_queries, source_queries, stream_queries, timing_queries

PARTS = [large, timing_queries, feature_queries, cooccurrence_queries, similarity_queries, label_queries, stream_queries, source_queries]
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in PARTS for k, s in p.SQL.items()}
