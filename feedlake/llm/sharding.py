"""Sharding by best-fit-decreasing bin packing of indivisible groups.

The packing itself needs only how many groups there are of each size, not the groups. Groups
are classed by the MANTISSA_BITS leading bits of their size, so the table of classes is bounded
however large the corpus is (2**MANTISSA_BITS rows for each doubling of the size, a million for
sizes up to 2**40). A class is packed as groups of its largest size if the capacity is fixed, so
no shard exceeds it, and of its mean size if the number of shards is, so their sums come out
right. That table alone goes to the driver, where best fit decreasing
runs over it through a balanced tree of remaining capacities; its answer, runs of "the next k
groups of this class enter this bin", is bounded the same way for a number of shards, and by the number of
bins for a fixed capacity; it is broadcast up to a size. Groups find their run by their rank within
the class, which is counted in buckets, and the rows of a hot group meet it by broadcast, so neither
a hot class nor a hot group meets in one task.

Defined results: a null text counts as empty (size 1); equal texts are one group and share a
shard; ties in size are broken by the group's hash; null doc_ids are rows like others, first among
their shard's slots of a bucket; an empty table gives no rows; columns other than those read are
ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import bucket_count, cut_lineage, join_hot, read_table, running_position

MANTISSA_BITS = 15
SHARDS = 8
#: Runs up to which the answer is broadcast; with a fixed capacity it grows with the bins, and beyond this many it is joined
#: by spans of so many ranks.
BROADCAST_RUNS, RANK_SPAN = 200_000, 64


class CapacityTree:
    """A treap of (remaining capacity, bin): find the tightest bin that still holds a size."""

    def __init__(self) -> None:
        self._root: list | None = None
        self._random = random.Random(0)

    def insert(self, key: tuple[int, int]) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._random.random(), None, None]), right)

    def remove(self, key: tuple[int, int]) -> None:
        left, rest = self._split(self._root, key)
        _, right = self._split(rest, (key[0], key[1] + 1))
        self._root = self._merge(left, right)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self._root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit_decreasing(
    classes: list[tuple[int, int]], capacity: int, most_bins: int | None = None
) -> tuple[int, list[tuple[int, int, int]]] | None:
    """(bins, runs of (size, bin, count)) for classes of (size, count); None: more than ``most_bins``.

    A size above the capacity gets a bin of its own.
    """
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        while count:
            found = tree.tightest(size)
            if found is None:
                if most_bins is not None and bins >= most_bins:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            else:
                tree.remove(found)
            room, where = found
            taken = min(count, room // size)
            runs.append((size, where, taken))
            tree.insert((room - taken * size, where))
            count -= taken
    return bins, runs


def equal_bins(classes: list[tuple[int, int]], n_bins: int) -> list[tuple[int, int, int]]:
    """Runs that fill ``n_bins`` near equally: the least capacity at which best fit needs no more.

    Groups above an equal share get a bin of their own first; the rest is dealt over the others.
    """
    rest, runs, first = sorted(classes, reverse=True), [], 0
    while rest and n_bins - first > 1:
        total = sum(s * c for s, c in rest)
        size, count = rest[0]
        if size * (n_bins - first) < total:
            break
        runs.append((size, first, 1))
        first += 1
        rest = ([(size, count - 1)] if count > 1 else []) + rest[1:]
    if not rest:
        return runs
    left = n_bins - first
    low = max(-(-sum(s * c for s, c in rest) // left), rest[0][0]) - 1
    step, found = 1, None
    while (found := best_fit_decreasing(rest, low + step, left)) is None:
        step *= 2
    high, low = low + step, low + step // 2
    while high - low > 1:
        middle = (low + high) // 2
        if (better := best_fit_decreasing(rest, middle, left)) is None:
            low = middle
        else:
            high, found = middle, better
    return runs + [(size, where + first, count) for size, where, count in found[1]]


def _size_class(size):
    """A size by its MANTISSA_BITS leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - MANTISSA_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def assign_bins(
    groups: DataFrame, n_bins: int | None = None, capacity: int | None = None
) -> DataFrame:
    """Adds ``bin`` to ``groups`` (group_key string, group_size long, one row a group).

    Give ``n_bins`` for that many near equal bins, or ``capacity`` for the fewest bins of a
    fixed capacity that best fit decreasing finds. Only a group above the capacity exceeds it, alone
    in its bin.
    """
    spark = groups.sparkSession
    classed = cut_lineage(groups.withColumn("size_class", _size_class(F.col("group_size"))))
    table = classed.groupBy("size_class").agg(F.count("*").alias("n"), F.sum("group_size").alias("b"), F.max("group_size").alias("most")).collect()
    packed = {r["size_class"]: -(-r["b"] // r["n"]) if n_bins else r["most"] for r in table}
    back = {size: c for c, size in packed.items()}  # mean and largest size lie inside the class
    sizes = [(packed[r["size_class"]], r["n"]) for r in table]
    runs = equal_bins(sizes, n_bins) if n_bins else best_fit_decreasing(sizes, capacity)[1]
    taken: dict[int, int] = {}
    rows = []
    for size, where, count in runs:
        c = back[size]
        rows.append((c, taken.get(c, 0), taken.get(c, 0) + count, where))
        taken[c] = taken.get(c, 0) + count
    runs_df = spark.createDataFrame(rows, "run_class long, run_from long, run_to long, bin int")
    buckets = bucket_count(sum(r["n"] for r in table))
    spread = F.pmod(F.xxhash64("group_key"), F.lit(buckets)).cast("int")
    ranked = running_position(classed, ["size_class"], spread, ["group_key"], buckets, None, "rank_in_class")
    fits = (
        (F.col("size_class") == F.col("run_class"))
        & (F.col("rank_in_class") >= F.col("run_from"))
        & (F.col("rank_in_class") < F.col("run_to"))
    )
    if len(rows) <= BROADCAST_RUNS:
        found = ranked.join(F.broadcast(runs_df), fits)
    else:  # a run meets its ranks by the spans that it touches
        span = lambda c: F.expr(f"{c} div {RANK_SPAN}")
        runs_df = runs_df.withColumn("run_span", F.explode(F.sequence(span("run_from"), span("(run_to - 1)"))))
        found = ranked.withColumn("rank_span", span("rank_in_class")).join(runs_df, fits & (F.col("rank_span") == F.col("run_span")))
        found = found.drop("rank_span", "run_span")
    return found.drop("run_class", "run_from", "run_to", "rank_in_class", "size_class")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``bytes``: shards hold near equal bytes (or, with ``capacity``, as few shards of
    that capacity as the method finds). Slots count up from 0 within a shard without gaps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group_key"),
    )
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"), F.count("*").alias("copies"))
    bins = assign_bins(groups, None if capacity else n_shards, capacity).select("group_key", "copies", F.col("bin").alias("shard"))
    placed = cut_lineage(join_hot(rows, bins, "group_key", "copies").drop("group_key", "copies"))
    buckets = bucket_count(placed.count() // max(1, n_shards))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    return running_position(placed, ["shard"], spread, ["doc_id", "text_crc32"], buckets, None, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
