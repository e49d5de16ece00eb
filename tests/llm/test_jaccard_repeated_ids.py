"""Rows that share a doc_id are judged by their texts."""

from feedlake.llm import jaccard


def test_rows_of_one_id_are_judged_by_text(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(3, text(1)), (7, text(2)), (7, text(3)), (7, text(3)), (9, text(1)), (9, text(4)), (12, text(5)), (12, text(5) + " more"), (15, ""), (15, text(6)), (None, text(1))]
    found = jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r["doc_id"], r["text"]) for r in found]
    want = {(3, text(1)), (7, text(2)), (7, text(3)), (9, text(4)), (15, ""), (15, text(6)), (None, text(1))}
    twelve = [g for g in got if g[0] == 12]
    assert len(twelve) == 1 and set(got) - set(twelve) == want and len(got) == len(want) + 1
