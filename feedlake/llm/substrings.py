"""Substring dedup with fixed-block anchors.

A repeat of WINDOW words holds at least one of the non-overlapping blocks of ANCHOR words into
which the other document is cut, since 2 * ANCHOR - 1 <= WINDOW. So:

1. Index and probe. Each document's aligned blocks are indexed, and all its rolling windows of
   ANCHOR words probe the index. Hashes are dealt over buckets by value; a probe that meets a
   block of another document is a hit.
2. Extend. Around its hits a document extends to every window of WINDOW words that holds one;
   these windows are compared whole (by 96 bits of two hashes), and overlapping ones make
   up the maximal repeats. A window goes where its words also start in a smaller doc_id.
3. Remove. The words covered by such windows are cut from the document.

Texts are dealt once by row, and that exchange serves all three steps. Between them travel
packed arrays, one row a chunk of documents and bucket: within a chunk equal hashes are folded
before they are sent, so a passage in a third of all documents costs a bucket one entry a chunk.
Chunks are cut from rows sorted by name, so a task that is run again makes the same ones.

Defined results: null and blank texts have no words; a text of fewer than WINDOW words loses
nothing; a null doc_id counts as larger than any other; rows of one doc_id never remove from each
other; repeated rows are reported each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import read_table
from feedlake.llm.jaccard import WORD, WordHashes

WINDOW, ANCHOR = 13, 7
#: A chunk's words: 1,024 for each bucket, so that its rows are well filled, between these bounds.
CHUNK_WORDS, MOST_WORDS = 60_000, 4_000_000
DOCS_PER_BUCKET = 20_000
OUT_ROWS = 512
LAST_ID = (1 << 63) - 1

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_OTHER_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def rolling(h: np.ndarray, width: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hashes of the windows of ``width`` word hashes, at each start; the last starts are junk."""
    out = np.zeros(len(h), np.uint64)
    for i in range(width):
        out[: len(h) - i] = out[: len(h) - i] * step + h[i:]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


class Chunk:
    """Documents side by side: uids, ids, starts in the row of all their word hashes."""

    def __init__(self) -> None:
        self.uids, self.ids, self.sizes, self.hashes, self.marks, self.words = [], [], [], [], [], 0

    def add(self, uid: int, doc_id: int, hashes: np.ndarray, marks: np.ndarray | None = None) -> None:
        self.uids.append(uid)
        self.ids.append(doc_id)
        self.sizes.append(len(hashes))
        self.hashes.append(hashes)
        self.marks.append(marks)
        self.words += len(hashes)

    def laid_out(self):
        self.uids, self.ids = np.array(self.uids, np.int64), np.array(self.ids, np.int64)
        sizes = np.array(self.sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(self.words) - self.starts[self.owner]
        self.left = sizes[self.owner] - self.place
        self.name = np.uint64(xxhash.xxh3_64_intdigest(self.uids.tobytes() + self.starts.tobytes())).view(np.int64)
        return np.concatenate(self.hashes)


def _changes(keys: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Where sorted keys differ from the one before."""
    if not len(keys):
        return np.zeros(0, bool)
    new = np.diff(keys) != 0
    return np.concatenate([[True], new if more is None else new | (np.diff(more) != 0)])


def fold(keys: np.ndarray, at: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of their first places: (rows of ``keys``, first places, whether
    repeated), and for each repeat its place and its key's first place. ``more`` are further bits of the keys.
    """
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    new = _changes(keys[order], None if more is None else more[order])
    group = np.cumsum(new) - 1
    firsts = order[new]
    more = ~new
    repeated = np.bincount(group, minlength=len(firsts)) > 1 if len(keys) else np.zeros(0, bool)
    again, of = at[order[more]], at[firsts[group[more]]]
    back = np.argsort(firsts, kind="stable")
    return firsts[back], at[firsts[back]], repeated[back], again, of


def _dealt(chunk: Chunk, buckets: int, parts: dict[str, tuple[np.ndarray, list[np.ndarray]]]) -> dict[int, dict]:
    """bucket -> name -> packed arrays (flags as bits), for parts given as (hashes, arrays in the same order)."""
    rows: dict[int, dict] = {}
    for name, (hashes, arrays) in parts.items():
        where = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        where = where[order]
        cuts = np.flatnonzero(np.diff(where)) + 1
        edges = np.concatenate([[0], cuts, [len(where)]]) if len(where) else [0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            rows.setdefault(int(where[lo]), {})[name] = [(np.packbits(a[order[lo:hi]]) if a.dtype == bool else a[order[lo:hi]]).tobytes() for a in arrays]
    return rows


_PACKED = "bucket int, chunk long, header boolean, wide boolean, a binary, b binary, c binary, d binary, e binary, f binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "chunk", "header", "wide", "a", "b", "c", "d", "e", "f"])


def _place_type(words: int):
    return np.uint16 if words <= 65_536 else np.uint32


def _in_planes(values: np.ndarray, kind) -> bytes:
    """Small numbers of ``kind``, all first bytes, then all second ones and so on: higher bytes are mostly 0 and
    take no space once the shuffle is compressed.
    """
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _from_planes(packed: bytes, wide: bool) -> np.ndarray:
    kind = np.uint32 if wide else np.uint16
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)


def _steps(places: bytes, kind) -> bytes:
    """Ascending places by their differences."""
    return _in_planes(np.diff(np.frombuffer(places, kind), prepend=kind(0)), kind)


def _header(chunk: Chunk, buckets: int, again: np.ndarray, of: np.ndarray) -> tuple:
    name, kind = int(chunk.name), _place_type(chunk.words)
    return (name % buckets, name, True, kind is np.uint32, chunk.uids.tobytes(), chunk.ids.tobytes(), chunk.starts.tobytes(),
            again.astype(kind).tobytes(), of.astype(kind).tobytes(), None)


def _index_rows(chunk: Chunk, buckets: int) -> pd.DataFrame:
    """Probes (a key, b place, c whether repeated in the chunk); blocks found once in the chunk,
    which probe as well (d key, e place); and blocks repeated in it (f: keys, first and last owner).
    """
    h = rolling(chunk.laid_out(), ANCHOR)
    whole = np.flatnonzero(chunk.left >= ANCHOR)
    keys = h[whole]
    first, at, repeated, again, of = fold(keys, whole)
    key = keys[first]
    once = ~repeated & (chunk.place[at] % ANCHOR == 0)
    aligned = np.concatenate([at[repeated], again])
    aligned = aligned[chunk.place[aligned] % ANCHOR == 0]
    order = np.argsort(h[aligned], kind="stable")
    block, owner = h[aligned][order], chunk.owner[aligned][order]
    new = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0])) if len(block) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(owner, new), np.maximum.reduceat(owner, new)) if len(new) else (new, new)
    kind = _place_type(chunk.words)
    parts = {
        "probe": (key[~once], [key[~once].astype(np.uint32), at[~once].astype(kind), repeated[~once]]),
        "once": (key[once], [key[once].astype(np.uint32), at[once].astype(kind)]),
        "more": (block[new], [np.stack([block[new].astype(np.uint32), low.astype(np.uint32), high.astype(np.uint32)], 1)]),
    }
    rows = [_header(chunk, buckets, again, of)]
    for bucket, packed in _dealt(chunk, buckets, parts).items():
        arrays = [*packed.get("probe", [b""] * 3), *packed.get("once", [b""] * 2), *packed.get("more", [b""])]
        arrays[1], arrays[4] = _steps(arrays[1], kind), _steps(arrays[4], kind)
        rows.append((bucket, int(chunk.name), False, kind is np.uint32, *arrays))
    return _frame(rows)


def _chunks(batches: Iterator[pd.DataFrame], most_words: int, marked: bool) -> Iterator[Chunk]:
    known, chunk = WordHashes(), Chunk()
    for batch in batches:
        marks = batch["at"] if marked else [None] * len(batch)
        for uid, doc_id, text, at in zip(batch["uid"], batch["doc_id"], batch["text"], marks):
            words = WORD.findall(text)
            if len(words) < WINDOW:
                continue
            if chunk.words and chunk.words + len(words) > most_words:
                yield chunk
                chunk = Chunk()
            chunk.add(uid, doc_id, np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), at)
    if chunk.words:
        yield chunk


def _joined(rows: pd.DataFrame, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """A packed column of all rows end to end, and the row of each value."""
    arrays = [np.frombuffer(x, kind) for x in rows[column]]
    return np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])


def _places(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.concatenate([np.cumsum(_from_planes(x, w)) for x, w in zip(rows[column], rows["wide"])]).astype(np.uint32)


def _flags(rows: pd.DataFrame, column: str, number: np.ndarray) -> np.ndarray:
    """A column of packed flags end to end; ``number`` tells the row of each."""
    sizes = np.bincount(number, minlength=len(rows))
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows[column], sizes)]).astype(bool)


def _replies(rows: pd.DataFrame, number: np.ndarray, *arrays: np.ndarray) -> pd.DataFrame:
    """One row a chunk with the arrays' values for it; ``number`` is sorted."""
    out = []
    cuts = np.flatnonzero(np.diff(number)) + 1
    edges = np.concatenate([[0], cuts, [len(number)]]) if len(number) else [0]
    names = rows["chunk"].to_numpy()
    for lo, hi in zip(edges[:-1], edges[1:]):
        packed = [a[lo:hi].tobytes() for a in arrays]
        out.append((-1, int(names[number[lo]]), False, False, *packed, *[None] * (6 - len(packed))))
    return _frame(out)


def _probe_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Headers as they are; for each chunk the places of its hits, and the owner of the block if
    the only one is in this chunk (else -1).
    """
    headers, rows = rows[rows["header"]], rows[~rows["header"]].reset_index(drop=True)
    if not len(rows):
        return headers
    once, once_number = _joined(rows, "d", np.uint32)
    once_at = _places(rows, "e")
    more, more_number = _joined(rows, "f", np.uint32)
    more, more_number = more.reshape(-1, 3).astype(np.int64), more_number[::3]
    key = np.concatenate([once, more[:, 0].astype(np.uint32)])
    if not len(key):
        return headers
    single = once_number.astype(np.int64) << 32
    first = np.concatenate([single, (more_number << 32) | more[:, 1]])
    last = np.concatenate([single, (more_number << 32) | more[:, 2]])
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    key, first, last = key[order][starts], np.minimum.reduceat(first[order], starts), np.maximum.reduceat(last[order], starts)
    probe, number = _joined(rows, "a", np.uint32)
    at, repeated = _places(rows, "b"), _flags(rows, "c", number)
    found = np.minimum(np.searchsorted(key, probe), len(key) - 1)
    hit = key[found] == probe
    found, number, at, repeated = found[hit], number[hit], at[hit], repeated[hit]
    own = (first[found] == last[found]) & (first[found] >> 32 == number)
    owner = np.where(own, first[found] & 0xFFFFFFFF, -1).astype(np.int32)
    worth = ~own | repeated
    shared = (first != last)[group[: len(once)]]  # blocks that another chunk has as well
    number = np.concatenate([number[worth], once_number[shared]])
    at = np.concatenate([at[worth], once_at[shared]])
    owner = np.concatenate([owner[worth], np.full(int(shared.sum()), -1, np.int32)])
    order = np.argsort(number, kind="stable")
    found = _replies(rows, number[order], at[order], owner[order])
    return pd.concat([headers, found], ignore_index=True) if len(headers) else found


def _header_of(rows: pd.DataFrame):
    head = rows[rows["header"]].iloc[0]
    uids, ids, starts = (np.frombuffer(head[c], np.int64) for c in "abc")
    again, of = (np.frombuffer(head[c], np.uint32 if head["wide"] else np.uint16).astype(np.int64) for c in "de")
    order = np.argsort(of, kind="stable")
    return uids, ids, starts, again[order], of[order]


def _with_repeats(at: np.ndarray, value: np.ndarray, again: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and values, and each value once more for every repeat of its place."""
    lo, hi = np.searchsorted(of, at, "left"), np.searchsorted(of, at, "right")
    n = hi - lo
    which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.concatenate([at, again[which]]), np.concatenate([value, np.repeat(value, n)])


def _by_document(uids: np.ndarray, starts: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """(uid, at): the places in each document, packed."""
    places = np.sort(places)
    owner = np.searchsorted(starts, places, "right") - 1
    cuts = np.flatnonzero(np.diff(owner)) + 1
    edges = np.concatenate([[0], cuts, [len(owner)]]) if len(owner) else [0]
    out = [(int(uids[owner[lo]]), (places[lo:hi] - starts[owner[lo]]).astype(np.int32).tobytes()) for lo, hi in zip(edges[:-1], edges[1:])]
    return pd.DataFrame(out, columns=["uid", "at"])


def _resolve_hits(rows: pd.DataFrame) -> pd.DataFrame:
    uids, _, starts, again, of = _header_of(rows)
    rows = rows[~rows["header"]]
    if not len(rows):
        return pd.DataFrame({"uid": [], "at": []})
    at, owner = _joined(rows, "a", np.uint32)[0].astype(np.int64), _joined(rows, "b", np.int32)[0]
    at, owner = _with_repeats(at, owner, again, of)
    return _by_document(uids, starts, at[np.searchsorted(starts, at, "right") - 1 != owner])


def _window_rows(chunk: Chunk, buckets: int) -> pd.DataFrame:
    hashes = chunk.laid_out()
    h, other = rolling(hashes, WINDOW), (rolling(hashes, WINDOW, _OTHER_STEP) >> np.uint64(32)).astype(np.uint32)
    steps = np.zeros(chunk.words + 1, np.int32)
    for start, size, at in zip(chunk.starts[:-1], chunk.sizes, chunk.marks):
        hits = np.frombuffer(at, np.int32)
        lo, hi = np.maximum(hits - (WINDOW - ANCHOR), 0), np.minimum(hits, size - WINDOW)
        fits = lo <= hi
        np.add.at(steps, start + lo[fits], 1)
        np.add.at(steps, start + hi[fits] + 1, -1)
    whole = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    keys, more = h[whole], other[whole]
    first, at, repeated, again, of = fold(keys, whole, more)
    ids = chunk.ids[chunk.owner]
    least = ids[at].copy()
    if len(again):
        row_of = np.full(chunk.words, -1, np.int64)
        row_of[at] = np.arange(len(at))
        np.minimum.at(least, row_of[of], ids[again])
    kind = _place_type(chunk.words)
    key = keys[first]
    parts = {"window": (key, [key, at.astype(kind), repeated, more[first], least])}
    rows = [_header(chunk, buckets, again, of)]
    for bucket, packed in _dealt(chunk, buckets, parts).items():
        *arrays, leasts = packed["window"]
        arrays[1] = _steps(arrays[1], kind)
        table, number = np.unique(np.frombuffer(leasts, np.int64), return_inverse=True)
        rows.append((bucket, int(chunk.name), False, kind is np.uint32, *arrays, _in_planes(number, kind), table.tobytes()))
    return _frame(rows)


def _window_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Headers as they are; for each chunk the places whose window starts in a smaller document
    than all of the chunk's, or is repeated in it, with the smallest doc_id.
    """
    headers, rows = rows[rows["header"]], rows[~rows["header"]].reset_index(drop=True)
    if not len(rows):
        return headers
    key, number = _joined(rows, "a", np.uint64)
    at, repeated, more = _places(rows, "b"), _flags(rows, "c", number), _joined(rows, "d", np.uint32)[0]
    sizes = [len(x) // 8 for x in rows["f"]]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    least = _joined(rows, "f", np.int64)[0][starts[number] + np.concatenate([_from_planes(x, w) for x, w in zip(rows["e"], rows["wide"])])]
    order = np.lexsort((more, key))
    new = _changes(key[order], more[order])
    best = np.empty(len(key), np.int64)
    best[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    worth = (best < least) | repeated
    found = _replies(rows, number[worth], at[worth], best[worth])
    return pd.concat([headers, found], ignore_index=True) if len(headers) else found


def _resolve_windows(rows: pd.DataFrame) -> pd.DataFrame:
    uids, ids, starts, again, of = _header_of(rows)
    rows = rows[~rows["header"]]
    if not len(rows):
        return pd.DataFrame({"uid": [], "at": []})
    at, best = _joined(rows, "a", np.uint32)[0].astype(np.int64), _joined(rows, "b", np.int64)[0]
    at, best = _with_repeats(at, best, again, of)
    return _by_document(uids, starts, at[best < ids[np.searchsorted(starts, at, "right") - 1]])


def covered(n_words: int, starts: bytes | None) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    steps = np.zeros(n_words + 1, np.int32)
    if starts is not None:
        at = np.unique(np.frombuffer(starts, np.int32))
        steps[at] += 1
        np.add.at(steps, at + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: uid, doc_id, text; windows: uid, at): the packed starts of the windows of each row
    whose words also start in a document with a smaller doc_id.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-docs.count() // DOCS_PER_BUCKET))
    most_words = min(MOST_WORDS, max(CHUNK_WORDS, 1_024 * buckets))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.xxhash64("doc_id", text).alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), text.alias("text")
    ).repartition(partitions, "uid")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, most_words, False):
            yield _index_rows(chunk, buckets)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, most_words, True):
            yield _window_rows(chunk, buckets)

    def once(found: DataFrame) -> DataFrame:
        return found.groupBy("uid").agg(F.first("at").alias("at"))  # repeated rows have the same places

    probed = rows.sortWithinPartitions("uid").mapInPandas(index, _PACKED).groupBy("bucket").applyInPandas(_probe_bucket, _PACKED)
    hits = once(probed.groupBy("chunk").applyInPandas(_resolve_hits, "uid long, at binary"))
    marked = rows.join(hits, "uid").sortWithinPartitions("uid")
    compared = marked.mapInPandas(windows, _PACKED).groupBy("bucket").applyInPandas(_window_bucket, _PACKED)
    return rows, once(compared.groupBy("chunk").applyInPandas(_resolve_windows, "uid long, at binary"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words left, joined by a space) for every row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), OUT_ROWS):
                part, out = batch.iloc[lo : lo + OUT_ROWS], []
                for doc_id, text, at in zip(part["doc_id"], part["text"], part["at"]):
                    words = WORD.findall(text)
                    gone = covered(len(words), at)
                    kept = " ".join(w for w, g in zip(words, gone) if not g) if gone.any() else " ".join(words)
                    out.append((None if doc_id == LAST_ID else doc_id, len(words), int(gone.sum()), kept))
                frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])
                yield frame.astype({"doc_id": "Int64"})

    rows, windows = repeated_windows(docs)
    return rows.join(windows, "uid", "left").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s FROM w WHERE len(w) >= {WINDOW})),
m AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + {WINDOW - 1})) AS p FROM g JOIN m USING (gram) WHERE m.least < g.doc_id),
k AS (SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM c GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept FROM words
  LEFT JOIN c ON c.doc_id = words.doc_id AND c.p = words.p WHERE c.p IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op5_substrings": op5_substrings}
ORACLE_SQL = {"op5_substrings": OP5_SQL}
