"""Secret scans with corpus-wide ownership frequency, DataFrame functions only.

Every candidate value is hashed and counted over the corpus by distinct repositories and owners:
a value with COPIED_OWNERS owners or more is a widely copied example; a value of one owner that
looks random is a live-looking credential. Candidates are the matches of the three fixed patterns
(base spans) and bare tokens of BARE_LEAST characters or more with a digit; a bare token becomes
a span of kind ``reuse`` when its value is a live-looking credential somewhere in the corpus and
the token lies in no base span. Values travel as SHA-256 only.

The candidates of all rows are worked out once and checkpointed. Counting is partial before it
shuffles, and the verdicts of very frequent values come back by broadcast, the others in a shuffle,
so a value in a third of all rows is no hot task. The work on a text grows with its length: the
places of its matches are running sums taken in two levels, and bare tokens meet the base spans around them in sorted
order, by windows over the text's spans.

Defined results: a null text is empty; a null owner is not counted as an owner (a value with
none is neither copied nor live); repeated rows are reported each and count as one repository;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.common import cut_lineage, join_hot, read_table

#: Fixed patterns: kind, pattern, group of the value, least characters of that group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The last two say the least length in the pattern: a run is taken whole, so the same spans are left.
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
BARE_LEAST = 16
BARE = rf"[A-Za-z0-9+/_.=-]{{{BARE_LEAST},}}"
COPIED_OWNERS = 3
LIVE_DISTINCT = 8
PART = 512
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of an array of longs up to each of its elements: within chunks of PART, then over the chunks'
    sums, since appending to one array would copy it for every element.
    """
    none, nothing = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    sums = lambda part: F.aggregate(part, none, lambda done, x: F.array_append(done, F.coalesce(F.get(done, F.size(done) - 1), nothing) + x))
    numbers = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int"))
    chunks = lambda v: F.transform(numbers(v), lambda k: sums(F.slice(v, k * PART + 1, F.lit(PART))))
    ends = lambda parts: sums(F.transform(parts, lambda c: F.element_at(c, -1)))
    moved = lambda parts, before: F.flatten(F.transform(parts, lambda c, k: bound(F.coalesce(F.get(before, k - 1), nothing), lambda o: F.transform(c, lambda x: x + o))))
    return bound(values, lambda v: F.when(F.size(v) > 0, bound(chunks(v), lambda parts: bound(ends(parts), lambda before: moved(parts, before)))).otherwise(none))


def spans_of(text: Column, kind: str, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points, failing ones dropped.

    The text between matches (split) and the matches themselves alternate, so the places are
    running sums of their lengths.
    """

    def placed(matches: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return F.transform(
            F.arrays_zip(running_sums(lengths).alias("e"), matches.alias("m"), values.alias("v")),
            lambda x: F.struct(
                (x["e"] - F.length(x["m"])).cast("int").alias("start"), F.lit(kind_no).alias("kind_no"), x["e"].cast("int").alias("end"),
                F.lit(kind).alias("kind"), x["v"].alias("value"),
            ),
        )

    spans = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.filter(spans, lambda s: F.length(s["value"]) >= least).cast(SPAN)


def candidate_spans(text: Column) -> Column:
    """All candidates of one text; each pattern runs only where a cheap test finds its mark."""
    low = F.lower(text)
    marks = {
        "assign": low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key"),
        "access": text.contains("AKIA"),
        "hex": text.rlike("[0-9a-f]{24}"),
    }
    none = F.array().cast(SPAN)
    parts = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        parts.append(F.when(marks[kind], spans_of(text, kind, no, pattern, group, least)).otherwise(none))
    bare = F.filter(spans_of(text, "reuse", len(BASE), BARE, 0, BARE_LEAST), lambda s: s["value"].rlike("[0-9]"))
    parts.append(F.when(text.rlike(BARE), bare).otherwise(none))
    return F.concat(*parts)


def looks_random(value: Column) -> Column:
    """Digits and letters, and at least LIVE_DISTINCT different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id and ``secrets`` for every row: its spans in order, each a struct of start, end, kind,
    value_sha256, owners, repositories and verdict (copied, live or unclear).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").alias("_doc"), F.col(owner).alias("_owner"),
        F.col(repository).alias("_repository"), candidate_spans(text).alias("_spans"),
    ).select("*", F.explode_outer("_spans").alias("s")).select(
        "_row", "_doc", "_owner", "_repository", "s.start", "s.kind_no", "s.end", "s.kind",
        # rows without candidates get keys of their own, or they would all meet in one task
        F.sha2(F.coalesce(F.col("s.value"), F.concat(F.lit("\n"), F.col("_row").cast("string"))), 256).alias("_hash"),
        looks_random(F.col("s.value")).alias("_random"),
    )
    rows = cut_lineage(rows)
    counted = (
        rows.where(F.col("kind").isNotNull())
        .groupBy("_hash")
        .agg(
            F.countDistinct("_owner").alias("owners"), F.countDistinct("_repository").alias("repositories"),
            F.max(F.col("kind_no") < len(BASE)).alias("_named"), F.max("_random").alias("_live"),
            F.count("*").alias("_rows"),
        )
        .select(
            "_hash", "owners", "repositories", "_named", "_rows",
            F.when(F.col("owners") >= COPIED_OWNERS, "copied").when(F.col("_live") & (F.col("owners") == 1) & F.col("_named"), "live").otherwise("unclear").alias("verdict"),
        )
    )
    joined = join_hot(rows, counted, "_hash", "_rows", "left")
    is_base = F.col("kind_no") < len(BASE)
    # a bare token inside a base span is that span's own value: it overlaps the furthest end of the base spans that
    # start before it, or the next base span
    onward = Window.partitionBy("_row").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = joined.withColumn("_reach", F.max(F.when(is_base, F.col("end"))).over(onward))
    marked = marked.withColumn("_next", F.last(F.when(is_base, F.col("start")), ignorenulls=True).over(backward))
    covered = F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    span = F.when(
        F.col("kind").isNotNull() & (is_base | ((F.col("verdict") == "live") & ~covered)),
        F.struct("start", "kind_no", "end", "kind", F.col("_hash").alias("value_sha256"), "owners", "repositories", "verdict"),
    )
    return marked.groupBy("_row").agg(F.first("_doc").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("secrets")).drop("_row")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan_secrets(docs)
    base = F.filter("secrets", lambda s: s["kind_no"] < len(BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    verdicts = lambda v: F.size(F.filter("secrets", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"),
        verdicts("live").alias("n_live"), verdicts("copied").alias("n_copied"),
    )


QUERIES = {"op4_secrets": op4_secrets}
ORACLE_SQL: dict[str, str] = {}
