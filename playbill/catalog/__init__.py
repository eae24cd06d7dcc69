"""Catalogue of queries over the driver's tables, with the SQL each one must equal."""

from playbill.catalog import entity_queries, listing_queries, source_queries, store_queries, text_queries

GROUPS = [listing_queries.registry, text_queries.registry, store_queries.registry, entity_queries.registry, source_queries.registry]


def queries() -> dict:
    return {name: query for group in GROUPS for name, query in group.queries.items()}


def oracles() -> dict[str, str]:
    return {name: text for group in GROUPS for name, text in group.oracles.items()}
