"""Many queries that ask for the same: their rows are dealt whole, and in blocks that repeat."""

import random

from pyspark.sql import functions as F

from feedlake.operators import postings, search

KEY = ["feed_id", "external_id"]


def made(spark, texts, each, rows):
    """found and members of ``texts`` texts with ``each`` queries, and the pairs that are to come."""
    rng = random.Random(7)
    hits = [(one, k % 5, str(k)) for k in range(rows) for one in rng.sample(range(texts), 3)]
    asks = [(one, 1000 + one + texts * i, f"s{one}" if i % 2 else None) for one in range(texts) for i in range(each)]
    of = {}
    for one, query, sort in asks:
        of.setdefault(one, []).append((query, sort))
    want = sorted((feed, row, query, sort or "") for one, feed, row in hits for query, sort in of[one])
    return spark.createDataFrame(hits, "query_id long, feed_id int, external_id string"), spark.createDataFrame(asks, "one long, query_id long, sort string"), want


def test_blocks_are_whole(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    for texts, each in ((10, 20), (3, 301)):  # more than a block of members, and a rest that is no eight
        found, members, want = made(spark, texts, each, 60)
        got = postings.dealt(found, members, KEY)
        assert got.columns == ["feed_id", "external_id", "query_id", "sort"]
        assert sorted((r.feed_id, r.external_id, r.query_id, r.sort or "") for r in got.collect()) == want


def test_rows_of_a_text_lie_together(spark):
    found, members, want = made(spark, 10, 20, 500)
    rows = postings.dealt(found, members, KEY).select(((F.col("query_id") - 1000) % 10).alias("one"), F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len(want)
    # before, each row was dealt to the queries of one text and the next row to those of another: some 1,300 changes
    changes = sum((a.task, a.one) != (b.task, b.one) for a, b in zip(rows, rows[1:]))
    assert changes < 10 * postings.PARTS


def test_members_are_cut_by_eights(spark):
    sizes = spark.range(1200).select(F.col("id").alias("n"), postings._cut(F.when(F.col("id") == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1), "id"))).alias("b"))
    for r in sizes.collect():
        assert [x for b in r.b for x in b] == list(range(1, r.n + 1))
        assert all(0 < len(b) <= postings.BLOCK for b in r.b) and all(len(b) % 8 == 0 or b is r.b[-1] for b in r.b)


def _changes(rows):
    return sum((a.task, a.text) != (b.task, b.text) for a, b in zip(rows, rows[1:]))


def _products(spark, n):
    name = "array('red plate', 'small ring', 'cold rod', 'red ring')[id % 4]"
    return spark.range(n).selectExpr("cast(id AS string) AS external_id", "id % 7 AS feed_id", f"{name} AS product_name", "'b' AS brand", "'f' AS feed_name", "'k' AS category", "'' AS colour", "'active' AS status")


def test_rows_found_by_substrings_lie_together(spark):
    texts = ("ed ing", "old", "mall ing", "ate")
    asked = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)], "query_id int, text string")
    plan = search.prepare(asked, search.default_synonyms(spark), spark.createDataFrame([("b",)], "brand string"))
    found = search.match_like(plan, _products(spark, 400), spark.createDataFrame([], "query_id int"))
    rows = found.select("query_id", "external_id", (F.col("query_id") % 4).alias("text"), F.spark_partition_id().alias("task")).collect()
    holds = {0: (3,), 1: (2,), 2: (1,), 3: (0,)}
    assert sorted((r.query_id, int(r.external_id)) for r in rows) == sorted((i, k) for i in range(200) for k in range(400) if k % 4 in holds[i % 4])
    assert _changes(rows) < 4 * postings.PARTS


def test_simple_search_deals_rows_in_blocks(spark):
    texts = ("red", "ring", "e", "l")
    asked = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)], "query_id int, text string")
    rows = search.search_simple(asked, _products(spark, 400)).select("query_id", "external_id", "product_name", (F.col("query_id") % 4).alias("text"), F.spark_partition_id().alias("task")).collect()
    names = ("red plate", "small ring", "cold rod", "red ring")
    assert sorted((r.query_id, int(r.external_id)) for r in rows) == sorted((i, k) for i in range(200) for k in range(400) if texts[i % 4] in names[k % 4])
    # as many tasks as the members of a text ask for, each with all rows of a part
    assert len({r.task for r in rows}) > 4 and _changes(rows) < 4 * postings.PARTS
