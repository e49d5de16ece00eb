"""The quality classifier learns from the whole of each labelled text."""

import random

from feedlake.llm import quality


def test_tails_of_labelled_texts_are_learned(spark):
    rng = random.Random(8)
    head = lambda: " ".join(f"plain{rng.randrange(3000)}" for _ in range(1900))
    tail = lambda kind: " ".join(f"{kind}{rng.randrange(200)}" for _ in range(3000))
    rows = [(i, head() + " " + tail("junk" if i % 2 else "good")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    assert all(len(t[: quality.TRAIN_BYTES]) == quality.TRAIN_BYTES and "junk" not in t[: quality.TRAIN_BYTES] for _, t in rows)
    assert model.score(tail("good")) > 0.9 and model.score(tail("junk")) < 0.1


def test_blocks_are_spread_over_the_text():
    found = quality.spread_blocks("a" * quality.BLOCK * 99 + "end")
    assert len(found) == quality.TRAIN_BYTES // quality.BLOCK and found[-1] == b"end" and quality.spread_blocks("") == []


def test_training_rows_are_bounded_by_rows(spark):
    from pyspark.sql import functions as F

    from feedlake.llm.labelled import training_rows

    docs = spark.createDataFrame([(i % 40 if i < 80 else 3, f"text {i}") for i in range(5_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = training_rows(docs, labels, "quality", 4, 2, 10)
    every = training_rows(docs, labels, "quality", 4, 2, 1_000)
    assert found.count() <= 10 and every.where("doc_id = 3").count() <= 1
    assert every.groupBy("doc_id").count().where(F.col("count") > 1).count() == 0
    again = {(r["doc_id"], r["text"]) for r in training_rows(docs.repartition(7), labels, "quality", 4, 2, 1_000).collect()}
    assert again == {(r["doc_id"], r["text"]) for r in every.collect()}


def test_score_from_the_fitted_parts(spark):
    """A score is the logistic curve of the compressed sizes, worked out from the fitted dictionaries alone."""
    import math

    import zstandard

    rng = random.Random(2)
    make = lambda kind, n: " ".join(f"{kind}{rng.randrange(300)}" for _ in range(n))
    docs = spark.createDataFrame([(i, make("bad" if i % 2 else "fine", 150)) for i in range(120)] + [(500, make("fine", 900)), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)]
    for r in quality.score_quality(docs, model).collect():
        data, saved = r["text"].encode(), 0
        for lo in range(0, len(data), quality.BLOCK):
            good, bad = (len(p.compress(data[lo : lo + quality.BLOCK])) for p in packers)
            saved += bad - good
        x = model.slope * (saved / len(data) if data else 0.0) + model.shift
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))) < 1e-9
