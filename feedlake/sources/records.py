"""Records of large delimited files by many tasks, though a quoted field may hold line ends.

A line alone doesn't tell whether it begins inside a quoted field. But it tells what state it ends in for either
beginning, and such functions of two states compose: only the last line that ends in one state whatever it began
in, and the number of lines since that swap the states, matter. So each task folds its block of the file, the
blocks (a row each) are folded in file order, and then every line knows where it begins. Lines that are
records by themselves stay where they are; only those of a record over several lines meet in a shuffle.

A quote that is never closed makes the rest of its file one record, as it does for a reader in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions.staging import staged


def ends_inside(line: Column, sep: str) -> Column:
    """Whether a line that begins outside of quotes ends inside a quoted field: whole quoted fields are taken out, and
    one is left that begins with a quote and has no closing one. Quotes within plain fields mean nothing.
    """
    s = re.escape(sep)
    rest = F.regexp_replace(line, rf'(^|{s})"(?:[^"]|"")*+"(?={s}|$)', "$1")
    return rest.rlike(rf'(?:^|{s})"(?:[^"]|"")*+$')


def _folded(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """``rows`` of (fixed, swaps) with ``known``, the state (inside or not) before a row in ``order``, or null if it hangs on
    the start, and ``turned``, whether the start's state is turned by then. fixed: the state after a row whatever
    was before, or null; swaps: whether the row turns the state.
    """
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_turns", F.sum(F.col("swaps").cast("int")).over(upto))
    fixed = F.when(F.col("fixed").isNotNull(), F.struct(F.col("fixed").alias("state"), F.col("_turns").alias("turns")))
    rows = rows.withColumns({"_last": F.last(fixed, ignorenulls=True).over(before), "_before": F.col("_turns") - F.col("swaps").cast("int")})
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    known = F.when(F.col("_last").isNotNull(), F.col("_last.state") != odd(F.col("_before") - F.col("_last.turns")))
    return rows.withColumns({"known": known, "turned": odd(F.col("_before"))}).drop("_turns", "_before", "_last")


def delimited_records(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """(path, block, line, record): every record of the files, header included; block and line tell the order in a file."""
    text = F.col("value")
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), text,
    )
    out, inside = ends_inside(text, sep), ends_inside(F.concat(F.lit('"'), text), sep)
    lines = lines.withColumns({"_out": out, "_in": inside})
    lines = lines.withColumns({"fixed": F.when(F.col("_out") == F.col("_in"), F.col("_out")), "swaps": F.col("_out") & ~F.col("_in")})
    lines = staged(_folded(lines, ["path", "block"], "line"))
    # a block as one row: where its last line leads
    after = F.when(F.col("known").isNull(), F.when(F.col("fixed").isNotNull(), F.col("fixed"))).otherwise(F.when(F.col("known"), F.col("_in")).otherwise(F.col("_out")))
    ends = lines.groupBy("path", "block").agg(F.max_by(F.struct(after.alias("fixed"), (F.col("turned") != F.col("swaps")).alias("swaps")), "line").alias("e"))
    blocks = _folded(ends.select("path", "block", "e.fixed", F.when(F.col("e.fixed").isNull(), F.col("e.swaps")).otherwise(False).alias("swaps")), ["path"], "block")
    blocks = blocks.select("path", "block", F.coalesce("known", "turned").alias("_start"))  # a file begins outside
    state = lines.join(blocks, ["path", "block"]).withColumn("_begins", F.coalesce(F.col("known"), F.col("_start") != F.col("turned")))
    state = state.withColumn("_ends", F.when(F.col("_begins"), F.col("_in")).otherwise(F.col("_out"))).select("path", "block", "line", "value", "_begins", "_ends")
    whole = state.where(~F.col("_begins") & ~F.col("_ends")).select("path", "block", "line", F.col("value").alias("record"))
    # lines of longer records: the last line before that began outside names the record, in this block or an earlier one
    parts = state.where(F.col("_begins") | F.col("_ends"))
    here = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last(F.when(~F.col("_begins"), F.struct("block", "line")), ignorenulls=True).over(here)
    parts = parts.withColumn("_own", own)
    lasts = parts.groupBy("path", "block").agg(F.max("_own").alias("_last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("path", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"))
    parts = parts.join(lasts, ["path", "block"]).withColumn("_first", F.coalesce("_own", "_earlier"))
    joined = parts.groupBy("path", "_first").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("all"))
    long = joined.select("path", "_first.block", "_first.line", F.array_join(F.transform("all", lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(long)


def numbered_records(records: DataFrame) -> DataFrame:
    """(number, record): records numbered from 0 in the order of path, block and line; blank ones and each file's first, its header, are left out.

    Records are numbered in their block; blocks, a row each, are added up in one task over all files.
    """
    rows = records.where(F.trim("record") != "")
    here = Window.partitionBy("path", "block").orderBy("line")
    rows = staged(rows.withColumn("_in_block", F.row_number().over(here) - 1))
    whole = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("_n")).withColumns({
        "_before": F.coalesce(F.sum("_n").over(whole), F.lit(0)), "_file": F.dense_rank().over(Window.orderBy("path")),
        "_opens": F.row_number().over(Window.partitionBy("path").orderBy("block")) == 1,
    }).drop("_n")
    number = F.col("_before") + F.col("_in_block") - F.col("_file")
    return rows.join(blocks, ["path", "block"]).where(~(F.col("_opens") & (F.col("_in_block") == 0))).select(number.cast("long").alias("number"), "record")
