"""The graph, the shards and the audit of the embedding near-dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label int, copies string, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, "c", "s") for i, v in rows], SCHEMA)


def brute(rows):
    """(vec_id, n_links, component_id) by comparing all pairs of equal length."""
    ids = [i for i, _ in rows]
    link = np.zeros((len(rows), len(rows)), bool)
    for a, (_, v) in enumerate(rows):
        for b, (_, w) in enumerate(rows):
            if a != b and v is not None and w is not None and len(v) == len(w):
                link[a, b] = np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9
    label = list(ids)
    for _ in rows:
        label = [min([label[a], *(label[b] for b in np.flatnonzero(link[a]))]) for a in range(len(rows))]
    return sorted(zip(ids, link.sum(1).tolist(), label))


def linked(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link_vectors(df).collect())


def clusters(rng, n, width, noise=(0, 0.1, 0.25)):
    base = rng.normal(size=(n, width))
    return [b + rng.normal(scale=s, size=width) for b in base for s in noise]


@pytest.mark.parametrize("rows", [
    [(1, [1.0, 2.0])],
    [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
    [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [-1.0, 0.0])],
    [(4, [3.0])],
])
def test_small_tables(spark, rows):
    assert linked(table(spark, rows)) == brute(rows)


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(8)
    rows = list(enumerate([*clusters(rng, 2, 8), *clusters(rng, 1, 5), [1.0, 2.0, 3.0], -np.ones(8) * 1e200]))
    assert linked(table(spark, rows)) == brute(rows)


def test_shards_from_the_top_down(spark, monkeypatch):
    """Three levels of cells, a dense cell in blocks, and a vector of very many copies."""
    rng = np.random.default_rng(5)
    dense = rng.normal(size=12)
    vectors = [*clusters(rng, 60, 12), *(dense + rng.normal(scale=0.01, size=(50, 12))), *[dense] * 20]
    rows = list(enumerate(vectors))
    for name, value in (("SHARD_MOST", 24), ("PER_SHARD", 12), ("FAN_OUT", 8), ("BLOCK", 16), ("CHUNK", 40), ("LEVELS", 4)):
        monkeypatch.setattr(embeddings, name, value)
    monkeypatch.setattr("feedlake.llm.common.HOT_ROWS", 10)
    seen = []
    real = embeddings.audit_recall
    monkeypatch.setattr(embeddings, "audit_recall", lambda *a: seen.append(real(*a)) or seen[-1])
    assert linked(table(spark, rows)) == brute(rows)
    assert seen and all(0 <= r <= 1 for r in seen)


def test_low_recall_ends_in_an_exact_comparison(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = list(enumerate(clusters(rng, 10, 6)))
    monkeypatch.setattr(embeddings, "audit_recall", lambda *a: 0.0)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    assert linked(table(spark, rows)) == brute(rows)


def test_audit_counts_each_member_alike(spark):
    """A vector of many copies that was missed by one member only lowers that member's share."""
    rows = [(0, 1, [1.0, 0.0]), (20, 1_000, [1.0, 0.01]), (40, 1, [1.0, 0.02]), (60, 1, [0.0, 1.0])]
    members = spark.createDataFrame(rows, "node long, copies long, embedding array<double>")
    counts = spark.createDataFrame([(0, 1_001, 2), (20, 1, 1), (40, 1_000, 1)], "node long, n long, m long")
    assert embeddings.audit_recall(members, counts) == pytest.approx((1 + 0.5 + 0.5) / 3)
    assert embeddings.audit_recall(members.where("node = 60"), counts) == 1.0


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_graph_search_finds_the_links(n):
    rng = np.random.default_rng(n)
    x = embeddings.unit(np.concatenate([rng.normal(size=(n - n // 2, 16)), rng.normal(size=(1, 16)) + rng.normal(scale=0.2, size=(n // 2, 16))]))
    graph = embeddings.build_graph(x)
    near = graph.ravel()
    edges = np.stack([np.repeat(np.arange(n), graph.shape[1]), near], 1)[near >= 0]
    pairs = lambda ij: {(int(a), int(b)) for a, b in zip(*ij) if x[a] @ x[b] >= 0.9}
    found, true = pairs(embeddings.range_search(x, embeddings.undirected(n, edges), np.arange(n))), pairs(embeddings.all_pairs(x))
    assert found <= true and len(found) >= 0.98 * len(true)


def test_hot_join_equals_a_join(spark, monkeypatch):
    from feedlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(60).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    table = rows.where("k IS NOT NULL AND k <> 5").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(table, "k", how).collect()))
        assert sorted(map(str, common.join_hot(rows, table, "k", "n", how).collect())) == want
