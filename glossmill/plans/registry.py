"""All queries of the vocabulary engine and their DuckDB SQL."""

from __future__ import annotations

from glossmill.plans import batch_queries, card_queries, gold_queries, source_queries, text_queries, vocabulary_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (text_queries, vocabulary_queries, card_queries, gold_queries, source_queries, batch_queries):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
