"""Phrases against a count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from feedlake.llm import phrases


def by_definition(rows, least, top, cover):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                count.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for (lang, *g), a in count.items():
        if len(g) == 1 or a < least:
            continue
        longer = [n for (other, *h), n in count.items() if other == lang and len(h) > len(g) and n >= least and (h[:2] == g or h[1:] == g)]
        if any(100 * n >= cover * a for n in longer):
            continue
        cuts = [(10**6 * a * a // (count[lang, *g[:k]] * count[lang, *g[k:]]), k) for k in range(1, len(g))]
        s, k = min(cuts)
        found.append((lang, " ".join(g), a, count[lang, *g[:k]], count[lang, *g[k:]], total[lang], s))
    out = []
    for lang in {r[0] for r in found}:
        own = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng, rows = random.Random(5), []
    common = [f"w{i}" for i in range(30)]
    fixed = ["New York City", "naïve Bayes", "É é", "hot dog stand", "as of", "San\tJosé"]
    for i in range(260):
        words = [rng.choice(fixed) if rng.random() < 0.15 else rng.choice(common) + rng.choice(["", "", "", ",", ".", "\n", " "]) for _ in range(60)]
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(words)))
    rows += [("en", "copied words stand here again and again . " * 3)] * 90  # a group of copies
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " . , \t"), ("long", "tick tack " * 20_000), ("x", "a b"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("least", "top", "cover"), [(10, 2_000, 50), (3, 5, 50), (2, 40, 80), (3, 1, 0)])
def test_equals_brute_force(spark, rows, least, top, cover, monkeypatch):
    monkeypatch.setattr(phrases, "FIRST", 1)
    monkeypatch.setattr(phrases, "GROWTH", 2)
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, a int, key string")
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, least, top, cover).collect())
    assert got == by_definition(rows, least, top, cover)


def test_full_bitmap_and_small_chunks(spark, rows, monkeypatch):
    """A bitmap that lets everything through gives the same rows."""
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 10)
    docs = spark.createDataFrame(rows[:120] + rows[-8:], "lang string, text string")
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, 3, 30).collect())
    assert got == by_definition(rows[:120] + rows[-8:], 3, 30, 50)


def test_waves_leave_nodes_out(spark, monkeypatch):
    """The first wave doesn't ask for pairs of low bounds, and the next one does only where a language isn't settled."""
    asked = []
    plain = phrases.count_triples
    monkeypatch.setattr(phrases, "count_triples", lambda docs, sieves, least: asked.append(sum(int(np.bitwise_count(s.words).sum()) for s in sieves[1:2])) or plain(docs, sieves, least))
    monkeypatch.setattr(phrases, "FIRST", 1)
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice([f"a{rng.randrange(6)}", f"fixed{k} pair{k}"]) for k in (rng.randrange(40) for _ in range(50)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, 5, 20).collect())
    assert got == by_definition(rows, 5, 20, 50)
    assert asked == sorted(asked) and asked[0] < 80


def test_empty(spark):
    found = phrases.mine_phrases(spark.createDataFrame([], "lang string, text string"))
    assert found.count() == 0 and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_001, 3_000_000_007, 3_100_000_011)], "a long, l long, r long").select(phrases.score("a", "l", "r")).first()
    assert row[0] == 10**6 * 3_000_000_001**2 // (3_000_000_007 * 3_100_000_011)
