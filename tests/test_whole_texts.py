"""Queries over texts read the whole of each, not its beginning."""

from collections import Counter

from feedlake.operators import search as q
from feedlake.plans import search_queries


def test_q3_to_q5_read_whole_documents(spark, tmp_path):
    texts = {1: " ".join(f"word{i}" for i in range(90)) + " straße\n\n running\tthe  word3 ", 2: "The and of", 3: "", 4: None, 5: " Größe " * 60 + "lastly"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, text in texts.items():
        every = (text or "").lower().split()
        want.update((i, w) for w in ([w for w in every if w not in q.STOP_WORDS] or every))
    got = {n: search_queries.QUERIES[n](spark, str(tmp_path)).collect() for n in ("q3_tokenize", "q4_stem", "q5_umlauts")}
    assert {(r["query_id"], r["token"]): r["n"] for r in got["q3_tokenize"]} == want
    words = sorted({w for _, w in want})
    assert sorted(r["token"] for r in got["q4_stem"]) == sorted(r["token"] for r in got["q5_umlauts"]) == words
    assert {"word89", "straße", "running", "lastly"} < set(words)
