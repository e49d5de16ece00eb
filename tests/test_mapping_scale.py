"""Mappings are learned by expressions, not by a Python call a feed."""

from feedlake.operators import mapping

CANDIDATES = [
    # feed_id, standard, rank, column, position, score
    (1, "id", 0, "a_id", 3, 85.0), (1, "id", 0, "b_id", 1, 85.0), (1, "title", 1, "name", 0, 90.0), (1, "brand", 5, "name", 0, 99.0), (1, "brand", 5, "maker", 4, 40.0),
    (1, "x", 6, "p", 0, 50.0), (1, "y", 6, "q", 1, 45.0), (2, "id", 0, "k", 0, None), (2, "id", 0, "l", 5, 31.0), (2, "price", None, "m", 0, 70.0),
]
FIXED = [(1, "price", "name", 2), (3, "id", "z", 0), (3, "id", "y", 1), (3, "title", "z", 1)]
WANT = {
    (1, "price", "name", 100.0), (1, "id", "b_id", 85.0), (1, "brand", "maker", 40.0), (1, "x", "p", 50.0), (2, "id", "l", 31.0), (3, "id", "z", 100.0), (3, "title", "z", 100.0),
}


def _learned(spark):
    candidates = spark.createDataFrame(CANDIDATES, "feed_id long, standard string, rank int, column string, position int, score double")
    return mapping.learn_mapping(candidates, spark.createDataFrame(FIXED, "feed_id long, standard string, column string, rank int"))


def test_columns_are_used_once_and_fixed_ones_come_first(spark):
    assert {tuple(r) for r in _learned(spark).collect()} == WANT


def test_no_python_runs_for_each_feed(spark):
    assert "Pandas" not in _learned(spark)._jdf.queryExecution().executedPlan().toString()
