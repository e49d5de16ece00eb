"""Inverted lists for batch search: which rows hold a term, and the rarest way into a query.

Postings are rows (term, key columns). A query is a set of groups of terms, each of which must be met by one
of its terms; ``drive`` enters every query through the group with the fewest postings, so that what is
compared in full is bounded by a query's rarest part. Substrings are found by grams: a text that holds a form
holds all its grams of GRAM characters, so the rarest of these leads to the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.staging import staged

GRAM = 3
#: Terms that are broadcast to the scan of the rows; more meet it in a shuffle.
MAX_BROADCAST = 200_000
#: Parts of the rows that meet queries in a shuffle, so that no query's rows are one task.
PARTS = 64
#: Up to so many terms are looked for in each text as they are; with more, the texts are taken apart into terms.
FEW = 64
#: Members of a query that a row is dealt to at a time; Parquet packs numbers by as many.
BLOCK = 504
SHORT = 128
#: Where queries that ask for the same are so many on average, their result is dealt by as many tasks as a shuffle has; by more where they are more.
MEMBERS_A_TASK = 16
MOST_TASKS = 4096


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters (size 0: the empty one)."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def form_grams(form: Column) -> Column:
    """The grams by which a form is looked up; a form shorter than GRAM is its own."""
    return F.when(F.length(form) < GRAM, F.array(form)).otherwise(grams(form, GRAM))


def gram_index(rows: DataFrame, key: list[str], text: str, sizes: tuple[int, ...] = (GRAM,)) -> DataFrame:
    """Postings (term, key columns) of a text column. To be stored and given to ``holding`` where the rows change seldom."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(text), n) for n in sizes])))
    return rows.select(*key, F.explode(every).alias("term"))


def fits_in(queries: DataFrame) -> bool:
    return queries.count() <= MAX_BROADCAST


def bounded(queries: DataFrame) -> DataFrame:
    """A table of few keys that many rows meet, marked for broadcast up to MAX_BROADCAST rows; it is counted first, so better staged."""
    return F.broadcast(queries) if fits_in(queries) else queries


def _cut(members: Column) -> Column:
    """An array in arrays of BLOCK, then of a multiple of 8, then the rest: numbers that are packed by eights repeat only so. A short
    array stays whole, since a rest would be another stretch of each row.
    """
    even = F.when(F.size(members) < SHORT, F.size(members)).otherwise(F.size(members) - F.size(members) % 8)
    starts = F.filter(F.sequence(F.lit(0), even, F.lit(BLOCK)), lambda i: i < even)
    blocks = F.transform(starts, lambda i: F.slice(members, i + 1, F.least(F.lit(BLOCK), even - i)))
    return F.concat(blocks, F.filter(F.array(F.slice(members, even + 1, F.size(members) - even)), lambda b: F.size(b) > 0))


def dealt(found: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Rows found for the first of the queries that ask for the same, for each of them. found: query_id of the first, and
    others; members: one (the first), query_id, and others; key: of the rows.

    Queries and rows that are many give a result of their product. It is made block by block, a row with BLOCK members of its
    query and then the next row, by tasks that hold few queries: so little memory is held, and in columnar files what repeats
    lies together.
    """
    members = staged(members)
    found = found.withColumnRenamed("query_id", "one")
    many = members.count()
    if many <= FEW:
        return found.join(F.broadcast(members), "one").drop("one")
    sizes = staged(members.groupBy("one").agg(F.ceil(F.count("*") / (8 * BLOCK)).alias("_heaps")))
    ones = sizes.count()
    member = F.struct(*[F.col(f"`{c}`") for c in members.columns if c != "one"])
    heap = F.pmod(F.xxhash64("query_id"), F.col("_heaps"))
    heaps = members.join(bounded(sizes), "one").groupBy("one", heap.alias("_heap")).agg(F.collect_list(member).alias("_all"))
    blocks = heaps.select("one", F.explode(_cut(F.col("_all"))).alias("_members"))
    # a query of many rows, or many queries that ask for the same, are PARTS keys; the more members a row has, the more tasks
    least = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(MOST_TASKS, least * many // (MEMBERS_A_TASK * max(1, ones))))
    on = ["one", "_part"]
    blocks = blocks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(tasks, *on)
    rows = found.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")).repartition(tasks, *on)
    # merged, each block meets the rows of its part in turn
    pairs = blocks.join(rows.hint("merge"), on)
    return pairs.select(*[F.col(f"`{c}`") for c in found.columns if c != "one"], F.explode("_members").alias("_member")).select("*", "_member.*").drop("_member")


def met(rows: DataFrame, entries: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Each row with the columns of each entry of which it meets a term, where it is read: nothing is shuffled. entries: terms
    (an array without repeats) and others, to be broadcast; tests: whether a row meets a term.
    """
    hits = F.array_compact(F.array(*[F.when(test, F.lit(term)) for term, test in tests.items()])) if tests else F.array().cast("array<string>")
    by_term = entries.select(F.explode("terms").alias("_term"), *entries.columns)
    # outer: a plain explode is read as a filter, which tests each term again
    found = rows.withColumn("_met", hits).withColumn("_term", F.explode_outer("_met")).join(F.broadcast(by_term), "_term")
    # a pair comes by the first of the entry's terms that the row meets, so once
    return found.where(F.get(F.array_intersect("terms", "_met"), F.lit(0)) == F.col("_term")).drop("_met", "_term", "terms")


def limited(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the given terms (one row a term), staged. The terms are counted before they are broadcast."""
    terms = staged(terms)
    fits = terms.count() <= MAX_BROADCAST
    return staged(postings.join(F.broadcast(terms) if fits else terms, "term", "left_semi"))


def scanned(rows: DataFrame, key: list[str], text: Column, terms: list[str]) -> DataFrame:
    """The postings of a few terms: one test of each text a term, and no terms made that nobody asks for."""
    if not terms:
        return rows.select(*key, F.lit("").alias("term")).where(F.lit(False))
    hits = F.array_compact(F.array(*[F.when(text.contains(F.lit(t)), F.lit(t)) for t in terms]))
    return staged(rows.select(*key, F.explode(hits).alias("term")))


def few(terms: DataFrame) -> list[str] | None:
    """The terms if there are at most FEW, else none."""
    first = [r[0] for r in terms.limit(FEW + 1).collect()]
    return first if len(first) <= FEW else None


def drive(asked: DataFrame, postings: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, key columns): rows that meet the group of each query with the fewest postings.
    asked: query_id, group, form, terms (an array: one term leads to the form's rows, the rarest is taken).
    """
    size = postings.groupBy("term").agg(F.count("*").alias("rows"))
    ways = asked.select("query_id", "group", "form", F.explode("terms").alias("term")).join(size, "term", "left")
    way = F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), F.col("term").alias("term")))
    rarest = ways.groupBy("query_id", "group", "form").agg(way.alias("way"))
    groups = rarest.groupBy("query_id", "group").agg(F.sum("way.rows").alias("rows"), F.collect_set("way.term").alias("terms"))
    best = groups.groupBy("query_id").agg(F.min(F.struct("rows", "group", "terms")).alias("best"))
    entries = staged(best.where("best.rows > 0").select("query_id", F.explode("best.terms").alias("term")))
    return postings.join(bounded(entries), "term").select("query_id", *key).distinct()


def holding(asked: DataFrame, rows: DataFrame, key: list[str], text: str, index: DataFrame | None = None) -> DataFrame:
    """(query_id, key columns): candidates for queries whose every group has a form that is a substring of ``text``; each
    row meets the grams of one group, so the caller still compares the forms. asked: query_id, group, form.

    index: stored postings of ``gram_index`` with all sizes asked for (those of GRAM, and 0 to GRAM - 1 where forms are shorter).
    """
    asked = staged(asked.withColumn("terms", form_grams(F.col("form"))))
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    if index is None:
        listed = few(terms)
        if listed is not None:
            return drive(asked, scanned(rows, key, F.col(text), listed), key)
        sizes = tuple(sorted(r[0] for r in terms.select(F.length("term")).distinct().collect()))  # of 0 to GRAM
        index = gram_index(rows, key, text, sizes or (GRAM,))
    return drive(asked, limited(index, terms), key)
