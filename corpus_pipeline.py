"""The corpus pipeline: five stages of training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes each stage as Parquet
into the shared checkpoint folder and rereads it as the next one's documents.

Defined results: null and blank texts and null doc_ids stay throughout; of repeated rows the
Jaccard stage keeps one, unless their doc_id is null; rows of one doc_id are judged by their texts;
of ties the smallest doc_id stays; extra columns pass through under any name, up to the last stage;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import read_table, set_aside, shared_folder
from feedlake.llm.decontamination import decontaminate
from feedlake.llm.jaccard import keep_one_of_each
from feedlake.llm.mixing import mix_sources
from feedlake.llm.sharding import shard_documents
from feedlake.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity machine rejects."""
    machine = train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    plain, back = set_aside(docs, "doc_id", "text")
    return score_toxicity(plain, machine, "_score").where(F.col("_score") < THRESHOLD).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights; none is passed over less than once, so no document goes."""
    plain, back = set_aside(docs, "doc_id", "source", "text")
    return mix_sources(plain, entropy_share=0.97, repetition=2.0, upsample_only=True).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its shard of near equal bytes and its slot there, a row for each row."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: A fitted classifier, MinHash and bin packing: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
