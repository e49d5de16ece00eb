"""Periodic run detection by Baier's grouping.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends.
Each document is searched in one task, without a shuffle:

1. Suspects. A run of ``least`` words or more that holds two periods repeats some stretch of
   ``least / 2`` words at distance q, and such stretches cover it without a gap. Hashes of these
   stretches leave the suspect parts of a text, each searched on its own; what they leave out holds
   no run, and equal hashes of different words only leave a part too many.
2. Lyndon arrays. Phase one of Baier's suffix sorter groups suffixes by their longest Lyndon prefix:
   groups are taken from the largest down, and every suffix hands its finished word to the nearest
   one before it that lies in a smaller group. The lengths of the groups' words are the Lyndon
   array. It is made for the order of the words and for the opposite one.
3. Extension. Every run has a root in one of the two arrays. All roots are extended at once to
   both sides by longest common extensions (bisection over prefix hashes). An extension can only come out
   too long; each run found is compared word by word, and if one fails all are made again with another base.

Time is n log n in a text's words, memory in proportion to the longest text of a batch.

Defined results: a null or blank text has no words and no runs; a null doc_id is kept and leaves its
text as it is; repeated rows are reported each; runs of different periods may overlap and are all
reported; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import read_table

#: Least words of a run.
LEAST = 12
#: Rounds of narrowing the suspect parts; more would change no result.
ROUNDS = 4
OUT_ROWS = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A Mersenne prime: products of two residues fit in 63 bits.
_PRIME = (1 << 31) - 1

Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """At each place the length of the longest Lyndon word that starts there, for words given as
    numbers 0, 1, ... and the order of these numbers (a prefix is smaller than what it begins).

    A group is a range of ``order``, named by its first index, so that groups compare as their
    names do; ``above`` leads from a place to the nearest one before it that isn't taken yet.
    """
    n = len(ranks)
    places = np.argsort(ranks, kind="stable")
    counts = np.bincount(ranks)
    first = np.cumsum(counts) - counts
    group = [0, *first[ranks].tolist()]
    size = [0] * n
    for g, c in zip(first.tolist(), counts.tolist()):
        if c:
            size[g] = c
    order = (places + 1).tolist()
    at = np.empty(n + 1, np.int64)
    at[places + 1] = np.arange(n)
    at = at.tolist()
    length = [1] * (n + 1)
    above = list(range(n + 1))
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        members = order[start : end + 1]
        word = length[members[0]]
        for i in members:
            above[i] = i - 1
        gets: dict[int, int] = {}
        for i in members:
            j = i - 1
            while above[j] != j:
                above[j] = j = above[above[j]]
            if j:
                gets[j] = gets.get(j, 0) + 1
        end = start - 1
        # what gets more copies of the word is larger, so it leaves its group first, for the group's end
        for copies in sorted(set(gets.values()), reverse=True):
            moved = [j for j, c in gets.items() if c == copies]
            for j in moved:
                g = group[j]
                size[g] = left = size[g] - 1
                other, place = order[g + left], at[j]
                order[place], at[other] = other, place
                order[g + left], at[j] = j, g + left
                length[j] += copies * word
            for j, g in [(j, group[j] + size[group[j]]) for j in moved]:
                group[j] = g
                size[g] += 1
    return np.array(length[1:], np.int64)


class Extensions:
    """Longest common extensions of places of one text to either side, for arrays of places."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        self.n = n = len(words)
        powers = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:
            more = min(done, n + 1 - done)
            powers[done : done + more] = powers[:more] * pow(base, done, _PRIME) % _PRIME
            done += more
        self.powers = powers
        self.sums = np.concatenate([[0], np.cumsum((words + 1) * powers[:n] % _PRIME)]) % _PRIME

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b = (self.sums[i + size] - self.sums[i]) % _PRIME, (self.sums[j + size] - self.sums[j]) % _PRIME
        return a * self.powers[j - i] % _PRIME == b

    def longest(self, most: np.ndarray, same: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = same(middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.longest(self.n - j, lambda size: self.same(i, j, size))

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.longest(i, lambda size: self.same(i - size, j - size, size))


def is_run(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether ``period`` holds from ``start`` to ``end`` and for neither neighbour."""
    return (
        bool((words[start : end - period] == words[start + period : end]).all())
        and (start == 0 or words[start - 1] != words[start + period - 1])
        and (end == len(words) or words[end] != words[end - period])
    )


def runs_of(words: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of ``least`` words or more of a text given as numbers 0, 1, ..."""
    if len(words) < 2:
        return []
    both = np.stack([lyndon_array(words), lyndon_array(words.max() - words)])
    i = np.tile(np.arange(len(words)), 2)
    j = i + both.ravel()
    i, j = np.divmod(np.unique(i * (len(words) + 1) + j), len(words) + 1)
    # a root that no word extends makes no run
    padded = np.concatenate([words, [-1, -2]])
    more = (padded[i] == padded[np.where(j < len(words), j, -1)]) | (padded[np.where(i > 0, i - 1, -1)] == padded[j - 1])
    i, j = i[more], j[more]
    base = 48_271
    while True:
        ways = Extensions(words, base)
        start, end, period = i - ways.left(i, j), j + ways.right(i, j), j - i
        fits = end - start >= np.maximum(least, 2 * period)
        found = np.unique(np.stack([start[fits], end[fits], period[fits]], 1), axis=0)
        if all(is_run(words, *r) for r in found.tolist()):
            return sorted((s, e - s, q) for s, e, q in found.tolist())
        base = base * 48_271 % _PRIME


def suspects(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Parts (start, end) of a text, given by its words' hashes, that may hold runs; no run lies outside them."""
    probe = max(1, -(-least // 2))
    found, todo = [], [(0, len(hashes), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo < max(2, least):
            continue
        part = hashes[lo:hi]
        grams = np.zeros(len(part) - probe + 1, np.uint64)
        for k in range(probe):
            grams = grams * _STEP + part[k : k + len(grams)]
        places = np.argsort(grams)
        same = np.diff(grams[places]) == 0
        if not same.any():
            continue
        again = places[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        edges = np.bincount(again, minlength=len(part) + 1) - np.bincount(again + probe, minlength=len(part) + 1)
        covered = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
        cuts = np.flatnonzero(covered[1:] != covered[:-1]) + lo
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
            if (a, b) == (lo, hi) or level == ROUNDS:
                found.append((a, b))
            else:
                todo.append((a, b, level + 1))
    return found


def text_runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """All runs of a text by start, then period."""
    if len(words) < least:
        return []
    found = []
    for lo, hi in suspects(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), least):
        names: dict[bytes, int] = {}
        part = np.array([names.setdefault(w, len(names)) for w in words[lo:hi]], np.int64)
        found += [(lo + s, size, q) for s, size, q in runs_of(part, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that lie in no run after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def find_periods(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, ``runs`` (structs of start, length, period by start, then period) and ``text``, the words
    joined by one space without those that repeat a period, for every row. ``rewrite`` changes a text's words first.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), OUT_ROWS):
                rows = []
                for doc_id, text in batch.iloc[lo : lo + OUT_ROWS].itertuples(index=False):
                    words = text.encode().split()  # of bytes: at space and U+0009 to U+000D only
                    if rewrite is not None:
                        words = rewrite(None if pd.isna(doc_id) else int(doc_id), words)
                    runs = text_runs(words, least)
                    rows.append((None if pd.isna(doc_id) else int(doc_id), len(words), [dict(start=s, length=n, period=q) for s, n, q in runs], b" ".join(collapsed(words, runs)).decode()))
                out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "text"])
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInPandas(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def unrolled(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: those of a tenth of all doc_ids become periodic from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_periods(read_table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=unrolled)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.less")).alias("length"),
        F.col("_best.period").alias("period"), F.expr("1000 * -_best.less div _best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periods": op13_periods}
ORACLE_SQL: dict[str, str] = {}
