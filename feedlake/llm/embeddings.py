"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors are one member. Members are dealt into shards from the top down: a cell of more
   than SHARD_MOST members gets centroids from a bounded sample of its own (SAMPLE members at most,
   in one task a cell), and its members enter the cells of their ``overlap`` nearest centroids.
   Vectors of different lengths begin in different cells. A cell whose centroids all lie closer
   than MERGED is dense: it is split no further, nor are cells below one that has fewer than
   SPREAD * ``overlap`` centroids left. Such shards of any size are cut into blocks of BLOCK members,
   and each pair of blocks is a task.
2. Each task builds a graph by inserting its members in batches: a beam search from the medoid over
   the graph so far gives the candidates, robust pruning with ALPHA keeps a few of them, reverse
   edges are added and pruned in turn. The adjacency lists of a member are united over its tasks.
3. Each task searches the united graph for each of its members: greedy search from the medoid,
   then range expansion, which follows every member within reach of the threshold. A range that
   holds a part of the block (WIDE) is compared with the whole block, which is exact and cheaper.
   Pairs are verified in double precision; a pair is counted in its smallest common shard only. A
   task returns link counts and a spanning forest, not pairs.
4. Recall is audited each time, for AUDIT members (ids divisible by 20 first) against all members,
   as the mean over the members that have links. Below RECALL the overlap is doubled; if twice
   that is not enough, pairs of blocks of each length are compared exactly.

Bounds: SAMPLE rows fit the centroids of a cell and AUDIT rows measure the recall; all else covers
every row.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link
with nothing and are kept; vectors of different lengths don't link; repeated rows are copies of
each other and link; null ids link with nothing; an empty table gives no rows; columns other than
vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import connected_components, cut_lineage, join_hot, read_table
from feedlake.llm.jaccard import forest

THRESHOLD = 0.9
SAMPLE = 8_192
PER_SHARD = 800
SHARD_MOST = 1_600
FAN_OUT = 256
SPREAD = 4
LEVELS = 8
MERGED = 0.95
OVERLAP = 2
BLOCK = 2_048
CHUNK = 20_000
BROADCAST_CELLS = 100_000
DEGREE, ALPHA = 16, 1.2
BATCH, BEAM, SEARCH_BEAM = 256, 24, 8
WIDE = 8
AUDIT = 2_048
RECALL = 0.98


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    # the largest component first, or squares of very large or small ones leave the range
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the sample; centroids closer than MERGED are one."""
    rng = np.random.default_rng(3)
    centers = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        near = np.argmax(sample @ centers.T, 1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centers)
    kept: list[int] = []
    for i in range(len(centers)):
        if not kept or (centers[kept] @ centers[i]).max() < MERGED:
            kept.append(i)
    return centers[kept]


def nearest_first(x: np.ndarray, rows: np.ndarray, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of each row (-1: none) from the nearest on, without repeats and the row itself, and their similarities."""
    score = np.einsum("bcd,bd->bc", x[cand], x[rows])
    order = np.argsort(cand, 1, kind="stable")
    sorted_ids = np.take_along_axis(cand, order, 1)
    again = np.zeros_like(cand, bool)
    np.put_along_axis(again, order, np.concatenate([np.zeros((len(cand), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], 1), 1)
    score = np.where((cand < 0) | again | (cand == rows[:, None]), -2.0, score)
    order = np.argsort(-score, 1, kind="stable")
    return np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)


def robust_prune(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """At most ``degree`` candidates of each row (padded with -1): the nearest left is taken, and those go
    that are ALPHA times nearer to it than to the row.
    """
    cand, score = nearest_first(x, rows, cand)
    cand, score = cand[:, : 3 * degree], score[:, : 3 * degree]
    out = np.full((len(rows), degree), -1, np.int32)
    vectors = x[cand]
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))))
    away = np.sqrt(np.maximum(0, 2 - 2 * score))
    alive = score > -1.5
    who = np.arange(len(rows))
    for d in range(degree):
        first = np.argmax(alive, 1)
        some = alive[who, first]
        if not some.any():
            break
        out[some, d] = cand[who, first][some]
        alive &= ~(ALPHA * apart[who, first] <= away)
        alive[who, first] = False
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best members that greedy search from ``start`` meets, and their similarities (-2: none)."""
    n, who = len(x), np.arange(len(queries))
    seen = np.zeros((len(queries), n), bool)
    seen[:, start] = True
    ids = np.full((len(queries), beam), start, np.int32)
    score = np.full((len(queries), beam), -2.0, x.dtype)
    score[:, 0] = queries @ x[start]
    done = np.ones((len(queries), beam), bool)
    done[:, 0] = False
    while not done.all():
        first = np.argmax(np.where(done, -3, score), 1)
        active = who[~done[who, first]]
        first = first[active]
        done[active, first] = True
        around = graph[ids[active, first]]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        seen[np.broadcast_to(active[:, None], around.shape)[fresh], around[fresh]] = True
        value = np.where(fresh, np.matmul(x[around], queries[active][:, :, None])[:, :, 0], np.array(-2.0, x.dtype))
        all_ids, all_score = np.concatenate([ids[active], around], 1), np.concatenate([score[active], value], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[active], score[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_score, all_done))
    return np.where(score > -1.5, ids, -1), score


def build_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency rows (padded with -1) by inserting the members in batches, the nearest to their mean first."""
    n = len(x)
    x = x.astype(np.float32)
    order = np.random.default_rng(n).permutation(n)
    medoid = int(np.argmax(x @ x.mean(0)))
    order = np.concatenate([[medoid], order[order != medoid]])
    graph, size = np.full((n, 2 * DEGREE), -1, np.int32), np.zeros(n, np.int64)
    done = 0
    while done < n:
        rows = order[done : done + min(BATCH, max(32, done))]
        own = np.broadcast_to(rows[None, :], (len(rows), len(rows)))
        if len(rows) > 32:  # of the batch itself, the nearest
            near = np.argpartition(-(x[rows] @ x[rows].T), 32, axis=1)[:, :32]
            own = rows[near]
        found = beam_search(x, graph, x[rows], medoid, BEAM)[0] if done else np.full((len(rows), 1), -1, np.int64)
        kept = robust_prune(x, rows, np.concatenate([found, own], 1))
        graph[rows, :DEGREE], size[rows] = kept, (kept >= 0).sum(1)
        # reverse edges, appended where there is room, else pruned together with them
        source, target = np.repeat(rows, DEGREE), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        place = size[target] + np.arange(len(target)) - np.repeat(first, count)
        wide = np.full((len(heads), 2 * DEGREE + int(count.max(initial=0))), -1, np.int64)
        wide[:, : 2 * DEGREE] = graph[heads]
        wide[np.repeat(np.arange(len(heads)), count), place] = source
        full = size[heads] + count > 2 * DEGREE
        graph[heads[~full]], size[heads[~full]] = wide[~full, : 2 * DEGREE], size[heads[~full]] + count[~full]
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // BATCH)):
            if len(part):
                pruned = robust_prune(x, heads[part], wide[part])
                graph[heads[part]] = -1
                graph[heads[part], :DEGREE], size[heads[part]] = pruned, (pruned >= 0).sum(1)
        done += len(rows)
    return graph


def undirected(n: int, edges: np.ndarray) -> np.ndarray:
    """Adjacency rows (padded with -1) that hold each edge (i, j) at both ends."""
    both = np.concatenate([edges, edges[:, ::-1]])
    key = np.unique(both[:, 0].astype(np.int64) * n + both[:, 1])
    a, b = key // n, key % n
    a, b = a[a != b], b[a != b]
    count = np.bincount(a, minlength=n)
    out = np.full((n, max(1, count.max(initial=0))), -1, np.int32)
    out[a, np.arange(len(a)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)] = b
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs within the threshold that the search finds, by row number."""
    n = len(x)
    low, small = x.astype(np.float32), threshold - 1e-4
    medoid = int(np.argmax(low @ low.mean(0)))
    out_q, out_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        who = np.arange(len(q))
        ids, score = beam_search(low, graph, low[q], medoid, SEARCH_BEAM)
        inside = (score >= small) & (ids >= 0)
        a, b = np.repeat(who, inside.sum(1)), ids[inside].astype(np.int64)
        key = np.unique(np.concatenate([a * n + b, who * n + q]))  # the query is a member itself
        seen = np.zeros(len(q) * n, bool)
        seen[key] = True
        found, wide = [key], np.zeros(len(q), bool)
        while len(key):
            counts = np.bincount(np.concatenate(found) // n, minlength=len(q))
            wide |= counts * WIDE > n
            key = key[~wide[key // n]]
            if not len(key):
                break
            grown = []
            for part in np.array_split(key, -(-len(key) * graph.shape[1] // 1_000_000)):
                around = graph[part % n]
                new = ((part // n)[:, None] * n + around)[around >= 0]
                new = np.unique(new[~seen[new]])
                seen[new] = True
                grown.append(new[np.einsum("ad,ad->a", low[q[new // n]], low[new % n]) >= small])
            key = np.concatenate(grown)
            found.append(key)
        key = np.concatenate(found)
        key = key[~wide[key // n]]
        if wide.any():  # ranges of a large part of the block
            whole = np.argwhere(low[q[wide]] @ low.T >= small)
            key = np.concatenate([key, who[wide][whole[:, 0]] * n + whole[:, 1]])
        out_q.append(q[key // n])
        out_m.append(key % n)
    a, b = np.concatenate(out_q), np.concatenate(out_m)
    return a[a != b], b[a != b]


def all_pairs(x: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing every pair, for the exact finish."""
    parts = [np.argwhere(x[lo : lo + 256] @ x.T >= threshold - 1e-6) + [lo, 0] for lo in range(0, len(x), 256)]
    pairs = np.concatenate(parts)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _tasks(rows: pd.DataFrame):
    for (_, bi, bj), part in rows.groupby(["shard", "bi", "bj"], sort=False):
        yield part.sort_values("node"), bi != bj


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    nodes, lists = [], []
    for part, _ in _tasks(rows):
        if len(part) > 1:
            ids = part["node"].to_numpy()
            nodes.append(ids)
            lists += [ids[r[r >= 0]].tobytes() for r in build_graph(unit(part["embedding"]))]
    return pd.DataFrame({"node": np.concatenate([np.zeros(0, np.int64), *nodes]), "near": pd.Series(lists, dtype=object)})


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value that rows of ``a`` and ``b`` share (both padded with the largest integer)."""
    most = np.iinfo(np.int64).max
    best = np.full(len(a), most)
    for k in range(a.shape[1]):
        shared = (a[:, k, None] == b).any(1)
        best = np.where(shared, np.minimum(best, a[:, k]), best)
    return best


def _links(rows: pd.DataFrame, exact: bool) -> pd.DataFrame:
    """Links counted by the member (b null): n with copies, m without; and a forest of links (n null)."""
    counted, hung = [np.zeros((3, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for part, cross in _tasks(rows):
        if len(part) < 2:
            continue
        ids, copies, blk = (part[c].to_numpy() for c in ("node", "copies", "blk"))
        x = unit(part["embedding"])
        if exact:
            i, j = all_pairs(x)
        else:
            near = [np.frombuffer(b"".join(v), np.int64) for v in part["near"]]
            ends = np.concatenate([np.zeros(0, np.int64), *near])
            row = np.minimum(np.searchsorted(ids, ends), len(ids) - 1)
            edges = np.stack([np.repeat(np.arange(len(ids)), [len(v) for v in near]), row], 1)[ids[row] == ends]
            i, j = range_search(x, undirected(len(ids), edges), np.arange(len(ids)))
        pairs = np.unique(np.minimum(i, j) * len(ids) + np.maximum(i, j))
        i, j = pairs // len(ids), pairs % len(ids)
        if cross:
            apart = blk[i] != blk[j]
            i, j = i[apart], j[apart]
        widest = max(map(len, part["shards"]))
        lists = np.full((len(part), widest), np.iinfo(np.int64).max)
        for k, own in enumerate(part["shards"]):
            lists[k, : len(own)] = own
        shard, good = part["shard"].iloc[0], np.zeros(len(i), bool)
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            good[lo : lo + 100_000] = (least_common(lists[a], lists[b]) == shard) & (np.einsum("ad,ad->a", x[a], x[b]) >= THRESHOLD)
        i, j = i[good], j[good]
        n = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
        m = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        some = m > 0
        counted.append(np.stack([ids[some], n[some].astype(np.int64), m[some].astype(np.int64)]))
        label = forest(len(ids), i, j)
        below = np.flatnonzero(label != np.arange(len(ids)))
        hung.append(np.stack([ids[below], ids[label[below]]]))
    counts, links = np.concatenate(counted, 1), np.concatenate(hung, 1)
    none = lambda k: pd.array([None] * k, "Int64")
    top = pd.DataFrame({"a": pd.array(counts[0], "Int64"), "b": none(counts.shape[1]), "n": pd.array(counts[1], "Int64"), "m": pd.array(counts[2], "Int64")})
    low = pd.DataFrame({"a": pd.array(links[0], "Int64"), "b": pd.array(links[1], "Int64"), "n": none(links.shape[1]), "m": none(links.shape[1])})
    return pd.concat([top, low], ignore_index=True)


def _searched(rows: pd.DataFrame) -> pd.DataFrame:
    return _links(rows, False)


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    return _links(rows, True)


def _split(placed: DataFrame, cells: DataFrame, overlap: int) -> DataFrame:
    """The members of ``cells`` (cell, size) in the cells below; ``whole``: of a dense cell, which stays."""
    inside = placed.where("NOT whole").join(F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells, "cell")
    rate = F.least(F.lit(1.0), F.lit(0.75 * SAMPLE) / F.col("size"))
    sample = inside.where(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1 << 30)) < rate * F.lit(1 << 30))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        k = int(max(SPREAD * overlap, min(FAN_OUT, overlap * rows["size"].iloc[0] // PER_SHARD)))
        centers = choose_centroids(unit(rows["embedding"]), min(k, len(rows)))
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "centers": [centers.tobytes()]})

    centers = sample.select("cell", "size", "node", "embedding").groupBy("cell").applyInPandas(fit, "cell long, centers binary")
    chunks = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    members = inside.withColumn("salt", F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int"))
    dealt = cells.join(centers, "cell").select(F.col("cell").alias("_cell"), "centers", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_salt"))

    def assign(rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        out = rows[["node", "copies", "embedding"]]
        if not len(rows):
            return out.assign(cell=pd.Series(dtype="int64"), whole=pd.Series(dtype=bool))
        cell = rows["cell"].iloc[0]
        if not len(made):  # no member of the cell came into its sample
            return out.assign(cell=cell, whole=True)
        x = unit(rows["embedding"])
        c = np.frombuffer(made["centers"].iloc[0], np.float64).reshape(-1, x.shape[1])
        if len(c) == 1:
            return out.assign(cell=cell, whole=True)
        top, last = min(overlap, len(c)), len(c) < SPREAD * overlap
        best = np.argpartition(-(x @ c.T), top - 1, axis=1)[:, :top]
        names = pd.util.hash_array(np.arange(len(c), dtype=np.uint64) + np.uint64(np.int64(cell).view(np.uint64))).view(np.int64)
        out = out.loc[out.index.repeat(top)].reset_index(drop=True)
        return out.assign(cell=names[best.ravel()], whole=last)

    found = members.groupBy("cell", "salt").cogroup(dealt.groupBy("_cell", "_salt")).applyInPandas(
        assign, "node long, copies long, embedding array<double>, cell long, whole boolean"
    )
    return found.dropDuplicates(["node", "cell"]) if overlap > 1 else found


def place(members: DataFrame, overlap: int) -> DataFrame:
    """``members`` with shard and shards: a row for each shard that a member is in."""
    placed = members.select("node", "copies", "embedding", F.xxhash64(F.size("embedding")).alias("cell"), F.lit(False).alias("whole"))
    for _ in range(LEVELS):
        cells = placed.where("NOT whole").groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > SHARD_MOST)
        cells = cut_lineage(cells)
        n_cells = cells.count()
        if not n_cells:
            break
        names = cells.select("cell") if n_cells > BROADCAST_CELLS else F.broadcast(cells.select("cell"))
        rest = placed.join(names, "cell", "left_anti")
        dense = placed.where("whole").join(names, "cell", "left_semi")
        placed = cut_lineage(rest.unionByName(dense).unionByName(_split(placed, cells, overlap)))
    lists = placed.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("shards"))
    return placed.withColumnRenamed("cell", "shard").drop("whole").join(lists, "node")


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows for each pair of blocks of its shard that a member is in."""
    sizes = rows.groupBy("shard").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = join_hot(rows, sizes, "shard", "size")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("bi", F.least("blk", "_other")).withColumn("bj", F.greatest("blk", "_other")).drop("_other", "size")


def _linked(members: DataFrame, overlap: int) -> DataFrame:
    rows = cut_lineage(_blocked(place(members, overlap)))
    near = rows.groupBy("shard", "bi", "bj").applyInPandas(_built, "node long, near binary")
    united = near.groupBy("node").agg(F.collect_set("near").alias("near"))
    ready = rows.join(united, "node", "left").withColumn("near", F.coalesce("near", F.array().cast("array<binary>")))
    return cut_lineage(ready.groupBy("shard", "bi", "bj").applyInPandas(_searched, "a long, b long, n long, m long"))


def _linked_exactly(members: DataFrame) -> DataFrame:
    """All pairs of blocks of each length; n vectors cost n * n / 2 comparisons, each row is copied n / BLOCK times."""
    shard = F.xxhash64(F.size("embedding"))
    rows = _blocked(members.withColumn("shard", shard).withColumn("shards", F.array(shard)))
    return cut_lineage(rows.groupBy("shard", "bi", "bj").applyInPandas(_compared, "a long, b long, n long, m long"))


def audit_recall(members: DataFrame, counts: DataFrame) -> float:
    """Mean share of its links (copies of a vector count once) that was found, over those of AUDIT members that have any."""
    asked = members.orderBy((F.col("node") % 20 != 0), F.xxhash64("node"), "node").limit(AUDIT).select("node", "embedding").toPandas()
    groups = {w: (g["node"].to_numpy(), unit(g["embedding"])) for w, g in asked.groupby(asked["embedding"].map(len))}
    shared = members.sparkSession.sparkContext.broadcast(groups)

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby(batch["embedding"].map(len)):
                if width in shared.value:
                    ids, x = shared.value[width]
                    hit = (x @ unit(part["embedding"]).T >= THRESHOLD) & (ids[:, None] != part["node"].to_numpy()[None, :])
                    n = hit.sum(1)
                    yield pd.DataFrame({"node": ids[n > 0], "true": n[n > 0]})

    true = members.select("node", "embedding").mapInPandas(brute, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    share = F.least(F.lit(1.0), F.coalesce("m", F.lit(0)) / F.col("true"))
    found = true.join(counts, "node", "left").agg(F.avg(share).alias("r")).first()["r"]
    shared.unpersist()
    return 1.0 if found is None else found


def link_vectors(vectors: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull() & ~bad & F.exists(v, lambda c: c != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v.cast("array<double>"), lambda c: c + F.lit(0.0)).alias("embedding"),
        F.coalesce(sound, F.lit(False)).alias("_sound"),
    )
    # equal vectors are known by 128 bits
    keyed = rows.where("_sound").withColumn("_key", F.concat(F.hex(F.xxhash64("embedding")), F.lit(":"), F.hex(F.xxhash64(F.lit(1), "embedding"))))
    members = keyed.groupBy("_key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    members = cut_lineage(members)
    alone = rows.where(~F.col("_sound")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if members.isEmpty():
        return alone
    usable = members.drop("_key")
    for share in (overlap, 2 * overlap, None):
        found = _linked(usable, share) if share else _linked_exactly(usable)
        counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        if share is None or audit_recall(usable, counts) >= RECALL:
            break
    linked = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = (
        members.join(counts, "node", "left").join(linked, "node", "left")
        .select("_key", "copies", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return join_hot(keyed.select("vec_id", "_key"), named, "_key", "copies").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    ).unionByName(alone)


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embeddings": op9_embeddings}
ORACLE_SQL: dict[str, str] = {}
