"""The plans that a search may take give the same rows: few terms or many, the first rows by a key or by places."""

import datetime

import pytest

from feedlake.operators import postings
from feedlake.operators import search as q

PRODUCTS = [
    # external_id, feed_id, product_name, brand, category, colour, price, original_price, last_updated
    ("1", 1, "Red plate-set - L", "Acme", "Kitchen > Plates", "Red", 10.0, 20.0, datetime.datetime(2024, 1, 3)),
    ("2", 1, "red plate-set - XL", "Acme", "Kitchen > Plates", "red", 9.0, 9.0, datetime.datetime(2024, 1, 5)),
    ("3", 1, "Platform heels", None, None, "", None, None, None),
    ("4", 2, "Rotor plates", "Plate", "Tools", "blue", 30.0, 60.0, datetime.datetime(2024, 1, 1)),
    ("5", 2, None, None, None, None, 5.0, None, datetime.datetime(2023, 1, 1)),
    ("6", 2, "Öl-kännchen plate", "B", "Kitchen", "red", -0.0, 3.0, datetime.datetime(2024, 1, 5)),
    ("7", 3, "hot plate", "B", "Kitchen", None, float("nan"), None, None),
    ("8", 3, "hot plate", "B", "Kitchen", "black", 30.0, 40.0, datetime.datetime(2024, 1, 1)),
]
QUERIES = [(1, "red plate", None), (2, "hot", "price_asc"), (3, '"hot plate"', "price_desc"), (4, "plate", "discount"), (5, "plate", "newest"), (6, "plate", "price_desc"), (7, "nothing here", None), (8, "", None), (9, None, None), (10, "kännchen", None)]


@pytest.fixture(scope="module")
def tables(spark):
    products = spark.createDataFrame(
        [(i, f, n, b, "feed", c, k, p, o, 1, "active", u) for i, f, n, b, c, k, p, o, u in PRODUCTS],
        "external_id string, feed_id int, product_name string, brand string, feed_name string, category string, colour string, price double, original_price double, in_stock int, status string, last_updated timestamp",
    )
    queries = spark.createDataFrame(QUERIES, "query_id int, text string, sort string")
    return queries, products, q.default_synonyms(spark), spark.createDataFrame([("acme",)], "brand string")


def keys(frame):
    return sorted((r.query_id, r.feed_id, r.external_id) for r in frame.collect())


def test_few_terms_and_many_lead_to_the_same_rows(tables, monkeypatch):
    queries, products, synonyms, brands = tables
    plan = q.prepare(queries, synonyms, brands)
    with_few = keys(q.match_fulltext(plan, products))
    monkeypatch.setattr(postings, "FEW", -1)
    assert keys(q.match_fulltext(plan, products)) == with_few
    assert (1, 1, "1") in with_few and (10, 2, "6") in with_few and all(k[0] not in (7, 8, 9) for k in with_few)


def test_search_shows_the_first_variants_in_the_order_of_their_places(tables):
    queries, products, synonyms, brands = tables
    found = q.filter_products(q.candidates(q.prepare(queries, synonyms, brands), products))
    by_places = q.page(q.dedup_variants(q.rank(q.score(q.filter_gender(found)))), 3, 1)
    places = lambda frame: sorted((r.query_id, r.place, r.feed_id, r.external_id) for r in frame.collect())
    assert places(q.search(queries, products, synonyms, brands, 3, 1)) == places(by_places)


def test_search_of_no_products_or_no_queries_is_empty(tables):
    queries, products, synonyms, brands = tables
    assert q.search(queries, products.where("1 = 0"), synonyms, brands).collect() == []
    assert q.search(queries.where("1 = 0"), products, synonyms, brands).collect() == []
