"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from feedlake.llm import decontamination, embeddings, html, jaccard, mixing, periods, phrases, private, quality, secrets, sharding, substrings, toxicity

MODULES = (jaccard, sharding, quality, secrets, substrings, decontamination, html, toxicity, embeddings, mixing, private, phrases, periods)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
