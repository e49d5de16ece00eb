"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles (a shorter one is a single shingle of its words).
Equal sets are one class member from the start, so copies are never compared. Candidates come
from BANDS bands of ROWS MinHash values: a pair at the threshold shares no band with a chance of
3 in a million, and the chance falls steeply above it. Three steps follow:

1. Band groups. Groups with the same members are taken once; inside a group, pairs compare their
   MinHash values BATCH at a time and are dropped once the posterior probability that their
   similarity reaches the threshold (uniform prior) is below TOLERANCE. A group returns a
   spanning forest of the pairs left, not the pairs.
2. Clusters. The connected components of the forests hold every pair that can be similar.
3. Verification. Inside a cluster the same pruning runs over all pairs and what is left is
   verified exactly on the shingle sets. A cluster returns a number of links per member and a
   spanning forest of its links.

Groups and clusters of more than BLOCK members are cut into blocks and every pair of blocks is a
task of its own, so no group is collected whole, and small ones are packed many to a task.
Members are known by a 64-bit hash of their set, shingles by 64-bit hashes.

Defined results: a null or blank text has no shingles and links with nothing; rows with a null
doc_id come back with a null class and no links; repeated rows are copies of each other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import connected_components, cut_lineage, join_hot, read_table, set_aside

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
BATCH = 16
TOLERANCE = 1e-6
BLOCK = 512
PACK_ROWS = 2_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_SEEDS = np.random.default_rng(11)
_XOR = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _SEEDS.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word to 64-bit hash, remembered; cleared when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingle_set(text: str | None, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = WORD.findall(text or "")
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * _STEP + h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2_048):
        h = np.bitwise_xor.outer(x[lo : lo + 2_048], _XOR)
        h *= _ODD
        np.minimum(best, h.min(0), out=best)
    return best


def set_node(shingles: np.ndarray) -> int:
    """A set's name: 64 bits, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def band_keys(signature: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for values in signature.reshape(BANDS, ROWS).T:
        out = (out ^ values.astype(np.uint64)) * _STEP
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair): with m of n equal and a uniform prior,
    P(similarity >= t) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        mass, below, m = (1 - threshold) ** (n + 1), 0.0, 0
        while below + mass < tolerance:
            below += mass
            mass *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append((n, m))
    return out


def likely_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of signatures that pruning leaves; ``same``: a is b, i < j."""
    kept_i, kept_j = [], []
    limits = least_matches()
    for lo in range(0, len(a), 128):
        rows = a[lo : lo + 128]
        n, least = limits[0]
        first = np.zeros((len(rows), len(b)), np.uint8)
        for k in range(n):
            first += rows[:, k, None] == b[None, :, k]
        keep = first >= least
        if same:
            keep &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(keep)
        equal = first[i, j].astype(np.int32)
        for done, least in limits[1:]:
            equal = equal + (rows[i, done - BATCH : done] == b[j, done - BATCH : done]).sum(1)
            keep = equal >= least
            i, j, equal = i[keep], j[keep], equal[keep]
        kept_i.append(i + lo)
        kept_j.append(j)
    return np.concatenate(kept_i), np.concatenate(kept_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row connected with each of n rows by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def exact_links(sets_a: list, sets_b: list, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs reach the threshold, by intersecting each set with an index of the b sets."""
    wanted, back = np.unique(j, return_inverse=True)
    sizes_b = np.array([len(sets_b[k]) for k in wanted])
    values = np.concatenate([sets_b[k] for k in wanted])
    owners = np.repeat(np.arange(len(wanted)), sizes_b)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    good = np.zeros(len(i), bool)
    by_row = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[by_row])) + 1
    for part in np.split(by_row, cuts):
        s = sets_a[i[part[0]]]
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(owners[at], minlength=len(wanted))[back[part]]
        # integers up to rounding at the threshold itself
        good[part] = common >= threshold * (len(s) + sizes_b[back[part]] - common) - 1e-9
    return good


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in batches:
        nodes, bands = [], []
        for text in batch["text"]:
            s = shingle_set(text, known)
            nodes.append(set_node(s) if len(s) else None)
            bands.append(band_keys(min_hashes(s)) if len(s) else None)
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "node": pd.array(nodes, "Int64"), "bands": bands})


def _with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, known) for t in batch["text"]]
        own = np.array([set_node(x) for x in sets], np.int64) == batch["node"].to_numpy()
        batch, sets = batch[own], [x for x, o in zip(sets, own) if o]  # not another text of the same doc_id
        yield batch.drop(columns="text").assign(signature=[min_hashes(s).tobytes() for s in sets], shingles=[s.tobytes() for s in sets])


def _parts(rows: pd.DataFrame):
    """(left rows, right rows, whether they are the same) for each block pair in a task."""
    for (_, bi, bj), part in rows.groupby(["grp", "bi", "bj"], sort=False):
        part = part.sort_values("node")
        if bi == bj:
            yield part, part, True
        else:
            yield part[part["blk"] == bi], part[part["blk"] == bj], False


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), BANDS * ROWS)


def _hung(left: np.ndarray, right: np.ndarray, same: bool, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, node) of a spanning forest of the pairs."""
    nodes = left if same else np.concatenate([left, right])
    label = forest(len(nodes), i, j if same else j + len(left))
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _candidate_forest(rows: pd.DataFrame) -> pd.DataFrame:
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left, right, same in _parts(rows):
        if len(left) and len(right):
            i, j = likely_pairs(_matrix(left), _matrix(right), same)
            a, b = _hung(left["node"].to_numpy(), right["node"].to_numpy(), same, i, j)
            out_a.append(a)
            out_b.append(b)
    return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def _verified(rows: pd.DataFrame) -> pd.DataFrame:
    """Links counted by the member (b null), and a forest of links (n null)."""
    counts, edges = [], []
    for left, right, same in _parts(rows):
        if not len(left) or not len(right):
            continue
        i, j = likely_pairs(_matrix(left), _matrix(right), same)
        if not len(i):
            continue
        sets = [[np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right)]
        good = exact_links(*sets, i, j)
        i, j = i[good], j[good]
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
        for nodes, n in ((a, np.bincount(i, weights=cb[j], minlength=len(a))), (b, np.bincount(j, weights=ca[i], minlength=len(b)))):
            some = n > 0
            counts.append(np.stack([nodes[some], n[some].astype(np.int64)]))
        edges.append(np.stack(_hung(a, b, same, i, j)))
    none = np.zeros((2, 0), np.int64)
    counted, hung = np.concatenate([none, *counts], 1), np.concatenate([none, *edges], 1)
    # nodes need all 64 bits, so nulls stay out of numpy
    empty = lambda n: pd.array([None] * n, "Int64")
    top = pd.DataFrame({"a": pd.array(counted[0], "Int64"), "b": empty(counted.shape[1]), "n": pd.array(counted[1], "Int64")})
    low = pd.DataFrame({"a": pd.array(hung[0], "Int64"), "b": pd.array(hung[1], "Int64"), "n": empty(hung.shape[1])})
    return pd.concat([top, low], ignore_index=True)


def in_tasks(members: DataFrame, grp: str, size: str) -> DataFrame:
    """Adds grp, bi, bj, blk and task: a row for each block pair of its group that a member is in.

    ``size`` names the group's size. Groups up to BLOCK are one block and share tasks of about
    PACK_ROWS rows; larger ones have a task for each pair of blocks.
    """
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    rows = members.withColumn("grp", F.col(grp)).withColumn("blk", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("bi", F.least("blk", "_other")).withColumn("bj", F.greatest("blk", "_other")).drop("_other")
    packs = max(1, -(-members.count() // PACK_ROWS))
    whole = F.pmod(F.xxhash64("grp"), F.lit(packs))
    return rows.withColumn("task", F.when(F.col(size) <= BLOCK, whole).otherwise(F.xxhash64("grp", "bi", "bj")))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links for every row: the smallest doc_id reachable by links of
    similarity THRESHOLD or more, itself included, and how many other rows it links with directly.
    """
    return _classed(docs).select("doc_id", "class_id", "n_links")


def _classed(docs: DataFrame) -> DataFrame:
    """The same with ``text_key``, the hash of the row's text, and ``part``: a node that names the class, null for a row without."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut_lineage(texts.withColumn("text_key", F.xxhash64("text")).mapInPandas(_described, "doc_id long, text_key long, node long, bands array<long>"))
    listed = described.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = cut_lineage(
        listed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    groups = (
        banded.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("_least"), F.bit_xor(F.xxhash64("node")).alias("_all"))
        .where("members > 1")
        .groupBy("members", "_least", "_all").agg(F.min("band").alias("band"))
        .select("band", "members")
    )
    grouped = cut_lineage(banded.join(groups, "band"))

    def texts_of(members: DataFrame) -> DataFrame:
        """members (by node) with the text of each member's first document."""
        reps = members.join(nodes.select("node", F.col("rep").alias("doc_id"), "copies"), "node")
        # repeated rows of one doc_id meet here; partitioned by it already
        return texts.join(reps, "doc_id").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "node", "_h"]).drop("doc_id", "_h")

    # signatures are worked out once for the members of all groups, and again where sets are needed
    near = grouped.select("node").distinct()
    signed = texts_of(near).mapInPandas(_with_sets, "node long, copies long, signature binary, shingles binary")
    signed = cut_lineage(signed)
    tasks = in_tasks(grouped, "band", "members").select("task", "grp", "bi", "bj", "blk", "node")
    tasks = tasks.join(signed.select("node", "signature"), "node")
    pairs = tasks.groupBy("task").applyInPandas(_candidate_forest, "a long, b long")
    clusters = connected_components(pairs)
    sizes = cut_lineage(clusters.groupBy("component").agg(F.count("*").alias("members")))
    clustered = cut_lineage(clusters.join(sizes, "component"))
    tasks = in_tasks(clustered, "component", "members").select("task", "grp", "bi", "bj", "blk", "node").join(signed, "node")
    verified = cut_lineage(tasks.groupBy("task").applyInPandas(_verified, "a long, b long, n long"))
    counts = verified.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = connected_components(verified.where("b IS NOT NULL").select("a", "b"))
    least = linked.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    least = cut_lineage(least)  # its join with a hot component can be split then
    named = (
        nodes.select("node", "rep", "copies")
        .join(linked.join(least, "component").select("node", "class_id", "component"), "node", "left")
        .join(counts, "node", "left")
        .select("node", "copies", F.coalesce("component", "node").alias("part"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    found = join_hot(listed.select("doc_id", "text_key", "node"), named, "node", "copies").select("doc_id", "text_key", "part", "class_id", "n_links")
    alone = described.where(F.col("node").isNull() | F.col("doc_id").isNull())
    return found.unionByName(alone.select("doc_id", "text_key", F.lit(None).cast("long").alias("part"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; rows without doc_id stay, and rows of one doc_id are judged by text."""
    heads = _classed(docs).where("doc_id = class_id").select("doc_id", F.col("text_key").alias("_text_key"), "part")
    firsts = heads.where("part IS NOT NULL").groupBy("part", "doc_id").agg(F.min("_text_key").alias("_text_key"))
    firsts = firsts.select("doc_id", "_text_key").unionByName(heads.where("part IS NULL").drop("part"))
    keys = ["doc_id", "_text_key"]
    plain, back = set_aside(docs, "doc_id", "text")
    kept = plain.withColumn("_text_key", F.xxhash64("text")).join(firsts, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*back).unionByName(docs.where("doc_id IS NULL"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_jaccard": op1_jaccard}
ORACLE_SQL: dict[str, str] = {}
