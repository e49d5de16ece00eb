"""Fixed capacities of shards, blocks of the mix, and the scores without both labels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from feedlake.llm import mixing, quality, sharding, toxicity


def test_no_shard_exceeds_a_fixed_capacity(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(60_000, 500_000) + str(i)) for i in range(240)] + [(900, "y" * 1_200_000), (None, "null id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(docs, capacity=1_000_000).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    over = [r for r in out if r["b"] > 1_000_000]
    assert len(over) == 1 and over[0]["n"] == 1 and sum(r["n"] for r in out) == len(rows)
    assert len(out) <= math.ceil(sum(len(t or "") + 1 for _, t in rows) / 1_000_000) * 1.25


def test_runs_too_many_to_broadcast_are_joined(spark, monkeypatch):
    """Spans of ranks give the bins that the broadcast gives; classes of many groups run over several spans."""
    rng = random.Random(8)
    rows = [(f"g{i}", rng.choice([40, 41, 70, rng.randrange(1, 900)])) for i in range(1_500)]
    groups = spark.createDataFrame(rows, "group_key string, group_size long")
    for how in ({"capacity": 1_000}, {"n_bins": 7}):
        want = sorted(map(tuple, sharding.assign_bins(groups, **how).collect()))
        with monkeypatch.context() as m:
            m.setattr(sharding, "BROADCAST_RUNS", 0)
            joined = sharding.assign_bins(groups, **how)
            assert joined.columns == ["group_key", "group_size", "bin"]
            assert sorted(map(tuple, joined.collect())) == want and len(want) == len(rows)


def test_a_text_of_a_third_of_all_rows(spark, monkeypatch):
    """The hot text's rows meet their shard by broadcast, with the shard that the shuffle gives."""
    from feedlake.llm import common

    rows = [(i, "copied text" if i % 3 == 0 else f"text {i % 50}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, sharding.shard_documents(docs).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    assert sorted(map(str, sharding.shard_documents(docs).collect())) == want and len(want) == 900


def test_size_classes_hold_their_sizes(spark):
    sizes = [1, 2, 32_767, 32_768, 65_537, 10**6 + 7, 10**12 + 3]
    out = {r["s"]: r["c"] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select("s", sharding._size_class(F.col("s")).alias("c")).collect()}
    assert all(c <= s < c + max(1, s >> (sharding.MANTISSA_BITS - 1)) + 1 for s, c in out.items()) and out[32_767] == 32_767


def test_blocks_of_the_mix(spark):
    """Dealing, passes and blocks against a plain walk over the same order."""
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "a" if i % 4 else "b", "clash") for i in range(80)] + [(7, "w w", "a", "clash")] * 2 + [(None, None, None, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass string")
    out = mixing.mix_sources(docs, entropy_share=0.8, repetition=None, upsample_only=True, block_tokens=60)
    assert out.columns == ["doc_id", "text", "source", "mix_tokens", "mix_pass", "mix_weight", "mix_alpha", "mix_block"]
    got = sorted((str(r["source"]), r["mix_pass"], str(r["doc_id"]), str(r["text"]), r["mix_block"]) for r in out.collect())
    tokens = lambda t: max(1, len((t or "").split()))
    units = {}
    for i, t, s, _ in rows:
        units[(s, i, t)] = units.get((s, i, t), 0) + tokens(t)
    total = {s: sum(n for (x, _, _), n in units.items() if x == s) for s in ("a", "b", None)}
    whole = sum(total.values())
    alpha = out.first()["mix_alpha"]
    raw = {s: (n / whole) ** alpha for s, n in total.items()}
    weight = {s: x / sum(raw.values()) for s, x in raw.items()}
    ratio = max(total[s] / whole / weight[s] for s in total)
    blocks = max(1, round(ratio * whole / 60))
    hashes = spark.createDataFrame([(s, i, t, p) for s, i, t in units for p in range(40)], "source string, doc_id long, text string, p int")
    key = F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")))
    order = {(r["source"], r["doc_id"], r["text"], r["p"]): r["h"] for r in hashes.select("*", F.xxhash64(F.lit(1), "p", key).alias("h")).collect()}
    count = {}
    for i, t, s, _ in rows:
        count[(s, i, t)] = count.get((s, i, t), 0) + 1
    want = []
    from feedlake.llm.common import bucket_count

    buckets = bucket_count(len(units), 20_000)
    for s in total:
        budget = math.floor(weight[s] * ratio * whole * (1 + 1e-9) + 1e-6)
        place = 0
        for p in range(40):
            line = sorted((u for u in units if u[0] == s), key=lambda u: ((order[(*u, p)] >> 32) % buckets, order[(*u, p)], -1 if u[1] is None else u[1]))
            for u in line:
                if place + units[u] <= budget:
                    want += [(str(s), p, str(u[1]), str(u[2]), math.floor(place / budget * blocks))] * count[u]
                place += units[u]
    assert got == sorted(want)


def test_scores_without_both_labels_are_the_share(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(30)] + [(None, None, "s")], "doc_id long, text string, score string")
    ones = spark.createDataFrame([(i, 1, 1) for i in range(30)], "doc_id long, toxic int, quality int")
    toxic = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, ones))
    good = quality.score_quality(docs, quality.train_quality(docs, ones))
    for df in (toxic, good):
        low = df.agg(F.min("score")).first()[0]
        assert df.columns == docs.columns and df.count() == 31 and low == pytest.approx(1.0, abs=1e-4)
