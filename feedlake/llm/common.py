"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed separators of words: space and U+0009 to U+000D.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set on the context if it isn't yet.

    Only a local master without that setting (tests) gets a temporary folder; on a cluster a
    missing setting is an error, because executors can't see each other's local disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="feedlake-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns other than ``used`` under names that no operator gives, and the columns to select to get back those of ``df``."""
    hidden = {c: f"_kept_column_{i}" for i, c in enumerate(df.columns) if c not in used}
    plain = df.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in df.columns])
    return plain, [F.col(hidden[c]).alias(c) if c in hidden else F.col(c) for c in df.columns]


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a key from which it is hot; there are at most as many hot keys as HOT_KEYS.
HOT_ROWS, HOT_KEYS = 1_000, 20_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key; ``count`` tells how many rows a key has or more),
    without a hot task: keys of very many rows meet them by broadcast, the others in a shuffle.

    A hot key has HOT_ROWS rows or more, and more than a HOT_KEYS-th of all, so that no more than
    HOT_KEYS keys are broadcast. ``table`` is checkpointed, as it is read three times; null keys
    don't match. ``how``: inner or left.
    """
    table = cut_lineage(table)
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(HOT_ROWS, -(-total // HOT_KEYS))
    few = F.broadcast(table.where(hot).withColumn("_hot", F.lit(True)))
    near = rows.join(few, key, "left")
    found, rest = near.where(F.col("_hot")).drop("_hot"), near.where(F.col("_hot").isNull()).select(*rows.columns)
    return found.unionByName(rest.join(table.where(~hot), key, how).select(*found.columns))


def running_position(
    df: DataFrame, keys: list[str], spread: Column, order: list[str], buckets: int, measure: str | None, out: str
) -> DataFrame:
    """Exclusive running sum of ``measure`` (None: of rows) within ``keys``, exact for hot keys.

    Each key's rows are dealt into ``buckets`` by ``spread`` (an int column, 0 to buckets - 1)
    and ordered by (bucket, *order). A window runs inside a bucket only; the buckets' sums are
    added up over a table of one row per key and bucket. ``df`` is read twice.
    """
    amount = F.lit(1) if measure is None else F.col(measure)
    dealt = df.withColumn("_bucket", spread)
    by_key = [F.col(k) for k in keys]
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*by_key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_offset"),
    )
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by_key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("long")
    joined = dealt.withColumn("_here", here).join(sums, same)
    return joined.withColumn(out, F.col("_offset") + F.col("_here")).drop(
        "_bucket", "_b", "_offset", "_here", *[f"_k{i}" for i in range(len(keys))]
    )


def bucket_count(rows: int, per_bucket: int = 50_000, least: int = 16) -> int:
    """Buckets that grow with the rows, so that a bucket of a hot key stays bounded."""
    return max(least, -(-rows // per_bucket))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable by the links, itself included.

    Alternates large-star and small-star until no link changes. Each round hangs a node's
    neighbours under the smallest of them, so a hot node ends as a star of one row per
    neighbour and no neighbourhood is collected. Nodes without links don't occur.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = cut_lineage(links)
    signature = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # checkpointed, so that both sides of a join are plain exchanges and a hot node's side can be split
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        links = cut_lineage(small)
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if signature == (now["n"], now["h"]):
            break
        signature = (now["n"], now["h"])
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
