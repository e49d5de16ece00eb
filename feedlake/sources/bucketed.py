"""The product table in buckets of external_id, for catalogs that are looked up and updated far more often than they are laid out.

    layout = lay_out(products, "products_1", 512)          one shuffle of the catalog
    resolve(ids, read_buckets(layout))                      J1, J2: only the ids are shuffled
    layout = upsert_buckets(layout, updates, "products_2")  U3: only the updates are shuffled

A bucket is a task, and holds all rows of an id, so buckets should be as many as the catalog has times 128 MB; a catalog of which
one id has a large share is better left to plain joins, where adaptive execution splits it. A change writes a new
table under a new name, in the folder given or the warehouse, and readers of the old one aren't disturbed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from feedlake.operators.catalog import quick_sync, upsert

BUCKET_KEY = "external_id"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class Layout:
    table: str
    buckets: int
    folder: str | None = None


def _write(df: DataFrame, layout: Layout) -> Layout:
    out = df.write.bucketBy(layout.buckets, BUCKET_KEY).sortBy(BUCKET_KEY)
    if layout.folder is not None:
        out = out.option("path", f"{layout.folder}/{layout.table}")
    out.saveAsTable(layout.table)
    return layout


def lay_out(products: DataFrame, table: str, buckets: int, folder: str | None = None) -> Layout:
    """The whole table, one file a bucket; an existing table of that name is an error."""
    return _write(products.repartition(buckets, BUCKET_KEY), Layout(table, buckets, folder))


def read_buckets(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.table(layout.table)


@contextmanager
def one_key_suffices(spark: SparkSession) -> Iterator[None]:
    """Within it, joins on (external_id, feed_id) are planned on buckets of external_id as they are."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


def upsert_buckets(spark: SparkSession, layout: Layout, updates: DataFrame, table: str) -> Layout:
    """U3 into a new table of as many buckets. Kept rows are written where they were read, new ones by the
    tasks that hold their bucket, so a bucket has at most two files.
    """
    with one_key_suffices(spark):
        new = updates.repartition(layout.buckets, BUCKET_KEY)
        return _write(upsert(read_buckets(spark, layout), new), Layout(table, layout.buckets, layout.folder))


def sync_buckets(spark: SparkSession, layout: Layout, updates: DataFrame, table: str) -> Layout:
    """U6 into a new table of as many buckets."""
    with one_key_suffices(spark):
        return _write(quick_sync(read_buckets(spark, layout), updates), Layout(table, layout.buckets, layout.folder))
