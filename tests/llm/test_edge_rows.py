"""Nulls, repeated rows, very long texts, ties, empty tables and clashing columns for every operator on documents, and for the pipeline."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedlake.llm import decontamination, jaccard, quality, secrets, sharding, substrings, toxicity

# names that the operators use inside or return
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, shard string, slot string, class_id string, "
    "n_links string, node string, _id string, _h string, _row string, _source string, _text_key string, _score string, mix_pass string, n_hit string, items string"
)
CLASHES = len(SCHEMA.split(",")) - 5
ITEM = "the quick river fox jumps over a very lazy old dog near the stone bridge"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    giant = " ".join(f"g{k}" for k in range(60_000))
    rows = [(i, words(i, 30), "hot" if i % 3 else None) for i in range(40)]
    rows += [(40, rows[4][1], "b"), (41, rows[4][1] + " tail", "b"), (42, rows[4][1], "hot")]  # ties in size and similarity
    rows += [(50, None, "b"), (51, "", None), (52, " \t\n ", "b"), (None, words(99, 30), None), (None, None, None), (60, giant, "b"), (61, giant + " end", "b"), (62, "x" * 300_000, "b")]
    rows += [rows[7], rows[7], (7, words(98, 25), "b"), (70, f"{words(97, 20)} {ITEM} {words(96, 20)}", "hot"), (71, "naïve ퟿ 漢字 " + words(95, 12), "hot")]
    return [(i, t, None, s, None, 0.5, *["x"] * (CLASHES - 1)) for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """Folders of the given tables: these rows, and none."""
    folders = []
    for name, kept in (("full", docs), ("none", docs.limit(0))):
        folder = str(tmp_path_factory.mktemp(name))
        kept.write.parquet(f"{folder}/documents.parquet")
        labels = [(i, i % 2, int(i == 3), "x") for i in range(0, 40, 3)] + [(3, 1, 1, "x"), (None, 1, 1, "x"), (6, None, None, "x"), (999, 0, 0, "x")]
        spark.createDataFrame(labels if name == "full" else [], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
        items = [("i1", ITEM, "x"), ("i1", ITEM, "x"), (None, "tiny item", "x"), ("i3", None, "x"), ("i4", " ", "x")]
        spark.createDataFrame(items if name == "full" else [], "item_id string, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")
        folders.append(folder)
    return folders


QUERIES = quality.QUERIES | toxicity.QUERIES | sharding.QUERIES | secrets.QUERIES | substrings.QUERIES | decontamination.QUERIES | jaccard.QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_row(spark, tables, rows, name):
    full, none = tables
    found = QUERIES[name](spark, full)
    assert Counter(r["doc_id"] for r in found.collect()) == Counter(r[0] for r in rows)
    assert len(set(found.columns)) == len(found.columns)
    nothing = QUERIES[name](spark, none)
    assert nothing.count() == 0 and nothing.schema.names == found.schema.names


@pytest.mark.parametrize("name", ["op3_quality", "op8_toxicity"])
def test_scores_of_awkward_rows(spark, tables, name):
    found = QUERIES[name](spark, tables[0]).toPandas()
    assert found["score"].between(0, 1).all() and not found["held_out"][found["doc_id"].isna()].any()
    by_id = found.groupby("doc_id")["score"]
    assert by_id.nunique()[[50, 51, 40]].eq(1).all() and by_id.first()[50] == by_id.first()[51] and by_id.first()[40] == by_id.first()[42]


def test_links_of_ties_and_giants(docs):
    found = {(r["doc_id"], r["class_id"]) for r in jaccard.jaccard_classes(docs).where("doc_id IS NOT NULL").collect()}
    assert {(4, 4), (40, 4), (41, 4), (42, 4), (60, 60), (61, 60), (62, 62), (50, 50), (51, 51), (52, 52)} <= found
    assert {r["n_links"] for r in jaccard.jaccard_classes(docs).where("doc_id IS NULL").collect()} == {0}


def test_shards_of_awkward_rows(docs, rows):
    found = sharding.shard_documents(docs).collect()
    assert sorted((r["shard"], r["slot"]) for r in found) == sorted((s, k) for s, n in Counter(r["shard"] for r in found).items() for k in range(n))
    assert sum(r["size"] for r in found) == sum(len((r[1] or "").encode()) + 1 for r in rows)


def key(r):
    return (r["doc_id"], r["text"], r["source"])


def test_pipeline_on_awkward_rows(spark, tables, rows):
    full, none = tables
    docs = spark.read.parquet(f"{full}/documents.parquet")
    columns, seen = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    for name in stages:
        if name != "sharding":
            seen[name] = stages[name](spark, docs, full)
            assert seen[name].columns == columns
    before = Counter((r[0], r[1], r[3]) for r in rows)
    kept = {name: Counter(map(key, found.collect())) for name, found in seen.items()}
    assert kept["toxicity"] <= before and all({r["_h"], r["_row"], r["_text_key"], r["_score"], r["mix_pass"]} == {"x"} for found in seen.values() for r in found.collect())
    # one of each group stays, and what is like nothing else, blank texts and null ids included
    copies = {(40, rows[4][1], "b"), (41, rows[4][1] + " tail", "b"), (42, rows[4][1], "hot"), (61, rows[48][1] + " end", "b")}
    want = Counter({k: n if k[0] is None else 1 for k, n in before.items() if k not in copies})
    got = kept["ngram_jaccard_join"]
    assert got == want
    assert kept["benchmark_decontamination"] == Counter({k: n for k, n in before.items() if k[0] != 70})
    assert set(kept["source_mixing"]) == set(before) and all(kept["source_mixing"][k] >= n for k, n in before.items())
    out = corpus_pipeline.run(spark, full)
    assert out.select("shard").distinct().count() > 1 and out.where(F.col("doc_id") == 70).count() == 0
    assert corpus_pipeline.run(spark, none).count() == 0
