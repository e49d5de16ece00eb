"""Labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id, divisor: int):
    """crc32 of the doc_id as text, modulo ``divisor`` (null ids: -1, which is no remainder)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor)), F.lit(-1)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out remainder.

    Labels are cut down first, by the hash of the id, so that what is broadcast is bounded; null labels are
    skipped and an id labelled twice counts once. Of the rows that share a labelled id one is taken, by the
    hash of its text, before anything leaves its task, so ``most`` bounds the rows as well.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(id_remainder(F.col("doc_id"), divisor) != held_out)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text")))
    return found.groupBy("doc_id", "label").agg(one.alias("_one")).select("doc_id", F.col("_one.text").alias("text"), "label")
