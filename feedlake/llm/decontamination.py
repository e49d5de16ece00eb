"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

DataFrame functions only: each benchmark item gives its windows of NGRAM words (a shorter item is
one window). A window's anchor is the 64-bit hash of its length, first and last word; the set of
anchors is broadcast, and every window of a document probes it in the scan. What it lets through
is verified by joining the whole window against the benchmark's windows.

Sizes are counted before anything is broadcast. A pass broadcasts MAX_ANCHORS anchors at most; a
benchmark with more is searched in several passes over the documents, each with its share of the
anchors. The table of whole windows is broadcast up to MAX_BROADCAST windows, and is beyond that
joined in a shuffle, in SALTS copies, so that one passage in very many documents is no hot task.

Defined results: null and blank texts have no words and no hits; an item without words is never
hit; the windows of an item whose item_id is null count for the hit words, but the item isn't
listed; repeated document rows are reported each; repeated items of one id count once; an empty
benchmark hits nothing; extra columns are ignored (or kept, by ``decontaminate``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import cut_lineage, read_table, set_aside

NGRAM = 10
MAX_ANCHORS = 2_000_000
MAX_BROADCAST = 200_000
SALTS = 16
#: Fixed: what separates words once A-Z are lower-cased, and the same for text as it stands.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it was; lower() where no other letter has a lower case."""
    others = text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _words(text: Column, separators: str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    # only the first and the last part can be empty
    return F.filter(parts, lambda w: w != "")


def normalised_words(text: Column) -> Column:
    return _words(ascii_lower(text), SEPARATORS)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """gram, gram_words, first_word, last_word, items: the distinct windows of all items."""
    words = benchmark.select("item_id", normalised_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(NGRAM))
    windows = words.select(
        "item_id",
        length.alias("gram_words"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("g"),
    )
    return windows.groupBy(F.array_join("g", " ").alias("gram"), "gram_words").agg(
        F.first(F.element_at("g", 1)).alias("first_word"),
        F.first(F.element_at("g", -1)).alias("last_word"),
        F.collect_set("item_id").alias("items"),
    )


def _anchors(lengths: list[int]) -> Column:
    """Of a document's ``words``: 0, then the anchors of its windows, by length and start."""
    parts = [
        f"if(size(words) >= {n}, transform(sequence(1, size(words) - {n - 1}), i -> xxhash64({n}, get(words, i - 1), get(words, i + {n - 2}))), array())"
        for n in lengths
    ]
    return F.expr(f"concat(array(0L), {', '.join(parts)})")


def _place(lengths: list[int]) -> tuple[Column, Column]:
    """Start (from 1) and length of the window whose anchor stands at ``pos`` (from 1) in ``_anchors``."""
    at, before = None, F.lit(0)
    length = None
    for n in lengths:
        count = F.greatest(F.size("words") - (n - 1), F.lit(0))
        here = F.col("pos") <= before + count
        at = F.when(here, F.col("pos") - before) if at is None else at.when(here, F.col("pos") - before)
        length = F.when(here, n) if length is None else length.when(here, n)
        before = before + count
    return at, length


def find_hits(docs: DataFrame, benchmark: DataFrame, all_rows: bool = True) -> DataFrame:
    """A row for each row of ``docs`` (without ``all_rows``: each that has a candidate window): its
    columns but for text, then n_words, hit (sorted positions of the words inside a benchmark
    window, from 1) and items (sorted item ids as text).

    The other columns of ``docs`` travel with every candidate: keep them few and short. Those that
    clash with the new ones are left out.
    """
    grams = cut_lineage(benchmark_windows(benchmark))
    sizes = grams.agg(F.count("*").alias("n"), F.collect_set("gram_words").alias("lengths")).first()
    kept = [c for c in docs.columns if c not in ("text", "n_words", "hit", "items")]
    named = docs.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("_row"), "text")
    carried = [F.first(f"_d{i}").alias(c) for i, c in enumerate(kept)]
    if not sizes["n"]:
        return named.select(
            *[F.col(f"_d{i}").alias(c) for i, c in enumerate(kept)], F.size(normalised_words(F.col("text"))).cast("long").alias("n_words"),
            F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"),
        )
    lengths = sorted(sizes["lengths"], reverse=True)
    anchored = grams.select(F.xxhash64("gram_words", "first_word", "last_word").alias("anchor")).distinct()
    passes = -(-sizes["n"] // MAX_ANCHORS)
    if passes > 1:  # rows keep their numbers from pass to pass
        named = cut_lineage(named)
    rows = None
    for k in range(passes):
        words = named.select("*", normalised_words(F.col("text")).alias("words")).drop("text")
        every = words.select("*", F.size("words").cast("long").alias("n_words"), F.posexplode(_anchors(lengths)).alias("pos", "anchor"))
        known = F.broadcast(anchored.where(F.pmod("anchor", F.lit(passes)) == k).withColumn("_known", F.lit(True)))
        own = (F.col("pos") == 0) & F.lit(all_rows and k == 0)
        near = every.join(known, "anchor", "left").where((F.col("_known") & (F.col("pos") > 0)) | own)
        at, length = _place(lengths)
        near = near.select(*[c for c in named.columns if c != "text"], "n_words", F.when(F.col("pos") > 0, at).alias("at"), F.when(F.col("pos") > 0, length).alias("len"), "words")
        near = near.withColumn("_gram", F.when(F.col("at") > 0, F.array_join(F.slice("words", F.col("at"), F.col("len")), " "))).drop("words")
        rows = near if rows is None else rows.unionByName(near)
    table = grams.select(F.col("gram").alias("_gram"), "items")
    if sizes["n"] <= MAX_BROADCAST:
        found = rows.join(F.broadcast(table), "_gram", "left")
    else:
        # a row without candidates gets a key of its own, or they would all meet in one task
        salted = rows.withColumn("_salt", F.pmod("_row", F.lit(SALTS))).withColumn("_gram", F.coalesce("_gram", F.concat(F.lit("\n"), F.col("_row"))))
        copies = table.withColumn("_salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
        found = salted.join(copies, ["_gram", "_salt"], "left").drop("_salt")
    inside = F.when(F.col("items").isNotNull(), F.sequence(F.col("at"), F.col("at") + F.col("len") - 1))
    return (
        found.groupBy("_row")
        .agg(*carried, F.first("n_words").alias("n_words"), F.collect_set(inside).alias("_spans"), F.collect_set("items").alias("_items"))
        .withColumn("hit", F.array_sort(F.array_distinct(F.flatten("_spans"))))
        .withColumn("items", F.array_sort(F.array_distinct(F.transform(F.flatten("_items"), lambda x: x.cast("string")))))
        .drop("_row", "_spans", "_items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out
    of their texts; what stands between words stays.

    Hits are found on (doc_id, hash of the text) alone and meet the documents again by these.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain, back = set_aside(docs, "doc_id", "text")
    keyed = plain.withColumn("_h", F.xxhash64(text))
    slim = keyed.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), "text")
    found = find_hits(slim, benchmark, False).where(F.size("hit") > 0).groupBy("_id", "_g").agg(F.first("hit").alias("_hit"))
    same = keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["_h"] == found["_g"])
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(*back)
    spans = keyed.join(found, same, "left").select(
        *plain.columns, "_hit",
        _words(text, SEPARATORS_ANY_CASE).alias("_w"),
        F.regexp_extract_all(text, F.lit(SEPARATORS_ANY_CASE), F.lit(0)).alias("_gaps"),
        text.rlike(rf"^{SEPARATORS_ANY_CASE}").alias("_gap_first"),
    )
    word = "coalesce(if(array_contains(_hit, i), '', get(_w, i - 1)), '')"
    rebuilt = F.expr(
        f"array_join(transform(sequence(1, greatest(size(_w), 1)), i -> if(_gap_first, concat(coalesce(get(_gaps, i - 1), ''), {word}),"
        f" concat({word}, coalesce(get(_gaps, i - 1), '')))), '') || if(_gap_first and size(_gaps) > size(_w), coalesce(get(_gaps, size(_w)), ''), '')"
    )
    return spans.withColumn("text", F.when(F.size("_hit") > 0, rebuilt).otherwise(F.col("text"))).select(*back)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
OP6_SQL = f"""
WITH iw AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(len(w), {NGRAM}) AS n,
       array_to_string(w[s:s + least(len(w), {NGRAM}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), {NGRAM}) + 1)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT dg.doc_id, dg.s, dg.n, ig.item_id FROM dg JOIN ig ON dg.n = ig.n AND dg.gram = ig.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL = {"op6_decontamination": OP6_SQL}
