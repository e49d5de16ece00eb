"""Runs, Lyndon arrays and collapsed texts against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedlake.llm import periods

TEXTS = st.lists(st.integers(0, 3), min_size=1, max_size=40)


def runs_by_definition(words, least):
    """(start, length, period) of every stretch by trying all periods; a stretch counts once, for its smallest."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        s = 0
        while s + q < len(words):
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q - s), q)
            s = e
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The contract's row, step by step."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words, 12)
    drop = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_lyndon_array(words):
    def lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    want = [max(k for k in range(1, len(words) - i + 1) if lyndon(words[i : i + k])) for i in range(len(words))]
    assert periods.lyndon_array(np.array(words)).tolist() == want


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 14))
def test_runs(words, least):
    assert sorted(periods.runs_of(np.array(words), least)) == sorted(runs_by_definition(words, least))
    assert periods.text_runs([b"%d" % w for w in words], least) == runs_by_definition(words, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9)), max_size=12))
def test_repeated_units(parts):
    words = [b"%d" % w for unit, times in parts for w in unit * times]
    assert periods.text_runs(words) == runs_by_definition(words, 12)


def test_long_texts_of_few_words():
    assert periods.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert periods.runs_of(np.tile(np.arange(7), 9_000)) == [(0, 63_000, 7)]
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert sorted(periods.runs_of(np.array(b[:2_000]))) == sorted(runs_by_definition(b[:2_000], 12))


def test_a_failed_hash_is_made_again(monkeypatch):
    made = []

    class Weak(periods.Extensions):
        def __init__(self, words, base):
            made.append(base)
            super().__init__(words, base)
            if len(made) == 1:
                self.sums = np.zeros_like(self.sums)  # everything looks equal

    monkeypatch.setattr(periods, "Extensions", Weak)
    words = [5, 4, *[1, 2, 3] * 6, 9, 8, 7, 7]
    assert periods.runs_of(np.array(words)) == runs_by_definition(words, 12) and len(made) == 2


@pytest.fixture(scope="module")
def rows():
    unit = "alpha beta gamma "
    found = [(i, f"x{i} y{i} " + unit * (i % 7 + 2) + f"\x85z{i}\x1ca b\tc\nd\x0be\x0cf\rg") for i in range(60)]
    found += [(100, None), (101, ""), (102, " \t\n "), (None, unit * 9), (None, None), (103, "x" * 200_000), (104, "same " * 30_000), (60, found[4][1]), found[5], found[5]]
    return found


def test_query_equals_brute_force(spark, rows, tmp_path):
    frame = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, runs string, n_words int, start string")
    frame.write.parquet(f"{tmp_path}/full/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    found = periods.op13_periods(spark, f"{tmp_path}/full")
    short = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = [expected(i, t) for i, t in rows if i != 104]
    got = [tuple(r) for r in found.collect()]
    assert sorted((r for r in got if r[0] != 104), key=short) == sorted(want, key=short)
    same = next(r for r in found.collect() if r["doc_id"] == 104)
    assert (same["n_runs"], same["start"], same["length"], same["period"], same["exponent_milli"]) == (1, 0, 30_000, 1, 30_000_000)
    assert same["collapsed_sha256"] == hashlib.sha256(b"same").hexdigest()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 2
    nothing = periods.op13_periods(spark, f"{tmp_path}/none")
    assert nothing.count() == 0 and nothing.schema == found.schema


def test_runs_and_texts(spark, rows):
    docs = spark.createDataFrame([(7, "a " + "b c d " * 5 + "e"), (8, "no run here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periods.find_periods(docs).collect()}
    assert [tuple(r) for r in got[7]["runs"]] == [(1, 15, 3)] and got[7]["text"] == "a b c d e" and got[7]["n_words"] == 17
    assert got[8]["runs"] == [] and got[8]["text"] == "no run here"
