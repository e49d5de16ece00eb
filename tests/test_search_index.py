"""Inverted lists, near words and exact places against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators import postings, search, spelling

KEY = ["feed_id", "external_id"]


def osa(a, b):
    """Edits between two words, a swap of neighbours counting as one, no part edited twice."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def slipped(rng, word, edits):
    for _ in range(edits):
        if not word:
            return word
        i = rng.randrange(len(word))
        word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcé") + word[i:], word[:i] + rng.choice("xyz") + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]])
    return word


def test_edit_distance(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("ca", "abc"), ("ab", "ba"), ("abcd", "badc")]
    pairs += [("".join(rng.choice("abé") for _ in range(rng.randrange(7))), "".join(rng.choice("abé") for _ in range(rng.randrange(7)))) for _ in range(400)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", spelling.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r["d"] == osa(r["a"], r["b"]) for r in got)


def test_near_words_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcde") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 9, 12, 22, 23, 24, 25, 26, 27, 40]))) for _ in range(500)}
    tokens = {t: min(2, len(t) // 4) for w in sorted(words) for t in [slipped(rng, w, rng.randrange(1, 4))] if len(t) >= 4} | {"x" * 300: 2}
    words |= {"x" * 298 + "yx"}
    got = spelling.near_words(spark.createDataFrame(list(tokens.items()), "token string, most int"), spark.createDataFrame([(w, 1) for w in words], "word string, freq long"))
    got = {(r["token"], r["word"], r["d"]) for r in got.collect()}
    want = {(t, w, osa(t, w)) for t, most in tokens.items() for w in words if abs(len(t) - len(w)) <= 2 and osa(t, w) <= most}
    assert got == want and {len(t) > 26 for t, _, _ in got} == {True, False} and {d for _, _, d in got} >= {1, 2}


def test_suggestions(spark):
    vocab = spark.createDataFrame([("adidas", 5), ("adidos", 9), ("shoe", 3), ("shop", 3)], "token string, freq long")
    asked = spark.createDataFrame([(1, ["adidsa", "red"]), (2, ["shoe"]), (3, ["shox"]), (4, []), (5, ["zzzzzz"])], "query_id int, tokens array<string>")
    assert {r["query_id"]: r["suggestion"] for r in search.did_you_mean(asked, vocab).collect()} == {1: "adidas red", 2: None, 3: "shoe", 5: None}


@pytest.mark.parametrize("broadcast", [0, 1_000])
def test_rows_that_hold_a_form(spark, broadcast, monkeypatch):
    monkeypatch.setattr(postings, "MAX_BROADCAST", broadcast)
    rng = random.Random(3)
    texts = {(k % 7, str(k)): "".join(rng.choice("abcdé ") for _ in range(rng.randrange(25))) for k in range(300)}
    asked = [(i, g, "".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 4, 5])))) for i in range(60) for g in range(rng.randrange(1, 3)) for _ in range(rng.randrange(1, 3))]
    asked += [(100, 0, ""), (101, 0, "zzz"), (101, 0, "ab"), (102, 0, "qqqq"), (102, 1, "a")]
    rows = spark.createDataFrame([(*k, t) for k, t in texts.items()], "feed_id int, external_id string, t string")
    got = {(r["query_id"], r["feed_id"], r["external_id"]) for r in postings.holding(spark.createDataFrame(asked, "query_id int, group int, form string"), rows, KEY, "t").collect()}
    groups = {}
    for i, g, f in asked:
        groups.setdefault(i, {}).setdefault(g, []).append(f)
    want = {(i, *k) for i, gs in groups.items() for k, t in texts.items() if all(any(f in t for f in fs) for fs in gs.values())}
    assert want <= got  # candidates
    # a candidate holds a gram of some group, so a query whose rarest part nothing holds has none
    assert not any(i == 102 for i, _, _ in got) and len(got) < 62 * len(texts) / 2


def test_a_stored_index_gives_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "small ring"), (2, "b", "red widget"), (3, "c", None)], "feed_id int, external_id string, t string")
    postings.gram_index(rows, KEY, "t", (0, 1, 2, 3)).write.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, 0, "idge"), (2, 0, "ng"), (3, 0, "")], "query_id int, group int, form string")
    for index in (None, spark.read.parquet(str(tmp_path / "index"))):
        got = {(r["query_id"], r["external_id"]) for r in postings.holding(asked, rows, KEY, "t", index).collect()}
        assert {(1, "b"), (2, "a"), (3, "a"), (3, "b")} <= got and (1, "a") not in got


def product_rows(rng, n):
    return [(k % 5, str(k), rng.choice(["small ring", "red ring - L", "blue widget"]), "b", "feed", "c", rng.choice(["red", ""]), float(rng.randrange(50)), float(rng.randrange(50)), 1, "active", f"2024-01-{1 + k % 20:02}") for k in range(n)]


PRODUCT = "feed_id int, external_id string, product_name string, brand string, feed_name string, category string, colour string, price double, original_price double, in_stock int, status string, last_updated string"


def test_places_over_many_ranges(spark):
    """One query with most rows: places go on from range to range, ties by the key."""
    rng = random.Random(5)
    rows = spark.createDataFrame(product_rows(rng, 900), PRODUCT)
    asked = F.when(F.col("external_id").cast("int") % 9 == 0, F.col("external_id").cast("int") % 4 + 2).otherwise(1)
    sort = F.when(asked == 2, "price_asc").when(asked == 3, "price_desc").when(asked == 4, "discount").when(asked == 5, "newest")
    cands = rows.withColumns({"query_id": asked, "sort": sort, "score": (F.col("external_id").cast("int") % 3)})
    found = search.rank(cands).collect()

    def order(r):
        off = (r["original_price"] - r["price"]) / r["original_price"] if r["original_price"] > r["price"] > 0 else 0.0
        lead = {2: r["price"], 3: -r["price"], 4: -off, 5: [-ord(c) for c in r["last_updated"]]}.get(r["query_id"], 0)
        return lead, -r["score"], r["external_id"], r["feed_id"]

    for i in range(1, 6):
        own = sorted((r for r in found if r["query_id"] == i), key=order)
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and own
    kept = search.dedup_variants(search.rank(cands)).collect()
    first = {}
    for r in sorted(found, key=lambda r: r["place"]):
        first.setdefault((r["query_id"], r["product_name"].removesuffix(" - L"), r["colour"]), r["external_id"])
    assert {(r["query_id"], r["external_id"]) for r in kept} == {(k[0], e) for k, e in first.items()}
    page = search.page(search.rank(cands), 7, 200).where("query_id = 1").orderBy("place").collect()
    assert [r["place"] for r in page] == list(range(201, 208))
    assert [r["external_id"] for r in page] == [r["external_id"] for r in sorted((r for r in found if r["query_id"] == 1), key=lambda r: r["place"])][200:207]


def test_empty_sides(spark):
    none = spark.createDataFrame([], PRODUCT)
    some = spark.createDataFrame(product_rows(random.Random(1), 20), PRODUCT)
    brands, synonyms = spark.createDataFrame([("b",)], "brand string"), search.default_synonyms(spark)
    asked = spark.createDataFrame([(1, "ring"), (2, ""), (3, None), (4, "mall rin"), (5, "ri")], "query_id int, text string")
    assert search.search(asked, none, synonyms, brands).count() == 0
    assert search.search(asked.limit(0), some, synonyms, brands).count() == 0
    assert {r["query_id"] for r in search.search(asked, some, synonyms, brands).collect()} == {1, 4, 5}
    assert {r["query_id"] for r in search.search_simple(asked, some).collect()} == {1, 2, 4, 5}


def test_no_plan_compares_all_rows_with_all_queries(spark):
    some = spark.createDataFrame(product_rows(random.Random(1), 20), PRODUCT)
    asked = spark.createDataFrame([(1, "ring"), (4, "mall rin"), (5, "ri")], "query_id int, text string")
    plan = search.prepare(asked, search.default_synonyms(spark), spark.createDataFrame([("b",)], "brand string"))
    matched = search.match_fulltext(plan, some)
    for df in (matched, search.match_like(plan, some, matched), search.search_simple(asked, some)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
