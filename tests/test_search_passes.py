"""A search takes the rows apart as few times as it can: what is read again is laid down first."""

import pytest
from pyspark.sql import functions as F

from feedlake.operators import search as q

ROWS = 40


@pytest.fixture
def counted(spark):
    """A column that counts how many rows it was made for, and its count."""
    seen = spark.sparkContext.accumulator(0)

    def tell(value):
        seen.add(1)
        return value

    return F.udf(tell, "string").asNondeterministic(), seen


def test_rows_are_ranked_from_one_pass(spark, counted):
    mark, seen = counted
    rows = spark.range(ROWS).selectExpr("id % 3 AS query_id", "id AS feed_id", "cast(id AS string) AS external_id", "double(id % 7) AS price", "double(9) AS original_price", "timestamp'2024-01-01' AS last_updated", "'price_asc' AS sort", "1 AS score")
    ranked = q.rank(rows.withColumn("external_id", mark("external_id"))).collect()
    assert seen.value == ROWS
    for k in range(3):
        own = sorted((r for r in ranked if r.query_id == k), key=lambda r: (r.price, r.external_id, r.feed_id))
        assert [r.place for r in own] == list(range(1, len(own) + 1))


def test_matched_rows_are_made_once_and_again_for_the_queries_without_any(spark, counted):
    mark, seen = counted
    rows = spark.range(ROWS).selectExpr("cast(id AS string) AS external_id", "id AS feed_id", "array('red plate', 'replated', 'x-pla te')[id % 3] AS product_name", "'B' AS brand", "'f' AS feed_name",
                                        "'K' AS category", "'' AS colour", "1D AS price", "2D AS original_price", "1 AS in_stock", "'active' AS status")
    products = rows.withColumn("product_name", mark("product_name"))
    queries = spark.createDataFrame([(1, "plate"), (2, "lated"), (3, '"la te"'), (4, "red pla.te")], "query_id int, text string")
    plan = q.prepare(queries, q.default_synonyms(spark), spark.createDataFrame([("b",)], "brand string"))
    found = q.candidates(plan, products).select("query_id", "external_id").collect()
    assert seen.value == 2 * ROWS
    want = [(1, i) for i in range(ROWS) if i % 3 == 0] + [(2, i) for i in range(ROWS) if i % 3 == 1] + [(3, i) for i in range(ROWS) if i % 3 == 2]
    assert sorted((r.query_id, int(r.external_id)) for r in found) == want


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(q, "ROWS_A_RANGE", 50)
    rows = spark.range(1000).selectExpr("id % 3 AS query_id", "id AS feed_id", "cast(id AS string) AS external_id", "double(id % 7) AS price", "double(9) AS original_price", "timestamp'2024-01-01' AS last_updated", "'price_asc' AS sort", "1 AS score")
    ranked = q.rank(rows)
    # before, all of so few bytes were put into one task
    held = [r[0] for r in ranked.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(held) > 8 and max(held) <= 6 * 50
    for k in range(3):
        own = sorted((r for r in ranked.where(F.col("query_id") == k).collect()), key=lambda r: (r.price, r.external_id, r.feed_id))
        assert [r.place for r in own] == list(range(1, len(own) + 1))
