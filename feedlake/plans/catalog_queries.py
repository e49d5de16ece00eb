"""Registered product-feed queries and their SQL twins, one pair a survey operator."""

from __future__ import annotations

from feedlake.plans import file_queries, lookup_queries, normalize_queries, report_queries, search_queries, source_queries, upsert_queries

GROUPS = (report_queries, lookup_queries, normalize_queries, upsert_queries, search_queries, source_queries, file_queries)


def queries():
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def oracle_sql():
    return {name: sql for group in GROUPS for name, sql in group.ORACLE_SQL.items()}
