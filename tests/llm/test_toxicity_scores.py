"""Scores of the fitted factorization machine, recomputed pair by pair."""

import math
import random
import re
import zlib

from feedlake.llm import toxicity


def test_scores_by_pairs_of_terms(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(60)}"
    rows = [(i, " ".join([word() for _ in range(12)] + (["insult", "people"] if i % 5 == 0 else ["insult"] if i % 5 == 1 else ["people"]))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert len(model.weights)
    for r in toxicity.score_toxicity(docs, model).collect():
        terms = set()
        for w in set(re.findall(r"\w+", r["text"].lower())):
            terms |= {zlib.crc32(t.encode()) & (toxicity.BINS - 1) for t in [w] + [f"{w[:n]}*" for n in (3, 4, 5, 6) if len(w) > n]}
        used = sorted(model.rows[t] for t in terms if t in model.rows)
        x = model.bias + sum(float(model.weights[k]) for k in used)
        x += sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(used) for b in used[i + 1 :])
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))) < 1e-4
