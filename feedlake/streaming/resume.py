"""T1 within a file: a delimited feed taken in by batches of records, taken up again at the first record that is not in the table.

The records of a feed are numbered once and laid down in pieces of a batch each, so that a batch, and a restart, reads its
piece alone. How many records are in is committed in the manifest together with their rows: after a stop at any point
nothing is missing and nothing comes in twice, and of two runs over one feed one takes up where the other is.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.staging import shared_folder
from feedlake.operators.catalog import KEY, dedup_last, upsert
from feedlake.sources import manifest, readers
from feedlake.sources.records import delimited_records, numbered_records
from feedlake.sources.tables import publish_change

#: The column that tells a record's place in its feed, from 0.
NUMBER = "record_number"
RECORDS = 1_000_000


def _pieces(spark: SparkSession, path: str, fmt: str, stamp: str, batch: int) -> tuple[DataFrame, manifest.Folder]:
    """(piece, number, record) of the feed, laid down in the shared folder unless an earlier run has done so."""
    folder = manifest.Folder(spark, f"{shared_folder(spark)}/records-{stamp}-{fmt}-{batch}")
    if not folder.has("_SUCCESS"):
        numbered = numbered_records(delimited_records(spark, path, readers.SEPARATORS[fmt]))
        draft = manifest.Folder(spark, f"{folder.name}-{uuid.uuid4().hex}")
        numbered.withColumn("piece", F.expr(f"number div {batch}")).write.partitionBy("piece").parquet(draft.name)
        if not folder.has("_SUCCESS"):
            folder.fs.rename(draft.base, folder.base)
        else:  # another run was faster
            draft.drop()
    return spark.read.schema("number long, record string, piece long").parquet(folder.name), folder


def ingest_records(
    spark: SparkSession, path: str, fmt: str, target: str, rows_of: Callable[[DataFrame], DataFrame], batch: int = RECORDS, most: int | None = None
) -> int:
    """Takes the feed at ``path`` (a file, or a folder of files in the order of their names) into the table at ``target``, ``batch``
    records at a time, and returns how many records are in. ``most``: batches of this call (None: all that are left).

    ``rows_of`` maps the feed's columns, all text, to product rows and keeps ``record_number``; of several records of a key the last
    counts (U3). Records that don't fit the header are numbered and dropped. Files that changed since are taken in anew
    from their first record. A feed that is in already isn't read. Each batch writes the feeds it touches whole, so batches should
    be large. The pieces are deleted when the feed is in.
    """
    at = manifest.Folder(spark, path)
    stamp = hashlib.sha256(repr(at.listing()).encode()).hexdigest()[:32]
    runs, pieces = 0, None
    while True:
        seen = manifest.current(spark, target).progress.get(at.name)
        mine = seen is not None and seen["stamp"] == stamp
        done = seen["records"] if mine else 0
        if mine and done == seen["of"]:
            if pieces is not None:
                pieces[1].drop()
            return done
        if most is not None and runs >= most:
            return done
        if pieces is None:
            pieces = _pieces(spark, path, fmt, stamp, batch)
            schema = readers.delimited_schema(spark, path, fmt)
            total = pieces[0].agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        upto = min(total, (done // batch + 1) * batch)
        part = pieces[0].where((F.col("piece") == done // batch) & (F.col("number") >= done)).withColumnRenamed("number", NUMBER)
        new = rows_of(readers.clean_names(readers.parsed_records(part, schema, fmt, NUMBER)))
        if NUMBER not in new.columns:
            raise ValueError(f"rows_of must keep {NUMBER}")
        new = dedup_last(new, KEY, [NUMBER]).drop(NUMBER).persist()
        try:
            feeds = [r[0] for r in new.select("feed_id").distinct().collect()]
            step = manifest.Progress(at.name, seen, {"stamp": stamp, "records": upto, "of": total})
            publish_change(spark, target, lambda old, new=new: new if old is None else upsert(old, new), feeds, step)
        except manifest.Overtaken:
            continue
        finally:
            new.unpersist()
        runs += 1
