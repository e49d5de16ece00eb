"""Queries that ask for the same are looked for once, and rows meet queries without a shuffle by query."""

import pytest

from feedlake.operators import postings
from feedlake.operators import search as q


@pytest.fixture(scope="module")
def tables(spark):
    products = spark.createDataFrame(
        [(str(i), i % 3, ("red plate", "Red plates", "cold ring", "old rod")[i % 4], "Acme", "feed", "Kitchen", ("", "red")[i % 2], 1.0, 2.0, 1, "active") for i in range(40)],
        "external_id string, feed_id int, product_name string, brand string, feed_name string, category string, colour string, price double, original_price double, in_stock int, status string",
    )
    texts = ["red plate"] * 3 + ["ed late"] * 2 + ["old rod", "old", "late", None, ""]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    return q.prepare(queries, q.default_synonyms(spark), spark.createDataFrame([("acme",)], "brand string")), queries, products


def keys(frame):
    return sorted((r.query_id, r.feed_id, r.external_id) for r in frame.select("query_id", "feed_id", "external_id").collect())


def found(plan, queries, products):
    return keys(q.match_fulltext(plan, products)), keys(q.match_like(plan, products, q.matched_queries(plan, products))), keys(q.search_simple(queries, products))


def test_equal_queries_get_equal_rows_by_each_way(tables, monkeypatch):
    plan, queries, products = tables
    first = found(plan, queries, products)
    full, like, simple = first
    assert [sum(k[0] == i for k in full) for i in range(10)] == [20, 20, 20, 0, 0, 10, 20, 0, 0, 0]
    assert [sum(k[0] == i for k in like) for i in range(10)] == [0, 0, 0, 20, 20, 0, 0, 20, 0, 0]
    assert [k[1:] for k in simple if k[0] == 0] == [k[1:] for k in simple if k[0] == 2]
    monkeypatch.setattr(postings, "MAX_BROADCAST", 2)
    assert found(plan, queries, products) == first
    monkeypatch.setattr(postings, "FEW", -1)
    assert found(plan, queries, products) == first


def test_matching_of_few_terms_shuffles_no_rows(tables):
    plan, _, products = tables
    assert "hashpartitioning" not in q.match_fulltext(plan, products)._jdf.queryExecution().executedPlan().toString()
