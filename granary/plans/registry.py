"""All registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from granary.plans import curation_queries, mixture_queries, nested_queries, text_queries, tokenizer_queries

REGISTRY: dict = {**text_queries.REGISTRY, **tokenizer_queries.REGISTRY, **curation_queries.REGISTRY, **mixture_queries.REGISTRY, **nested_queries.REGISTRY}


def queries() -> dict:
    return {k: q for k, (q, _) in REGISTRY.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
