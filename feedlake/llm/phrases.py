"""Phrase collocations by best-first branch-and-bound growth.

A phrase of two or three words is scored by the worst of its cuts, ``floor(10**6 * a * a / (l * r))``
from the counts of the phrase and of the cut's two parts. Phrases grow word by word:

1. Words are counted. A word of fewer than ``least`` occurrences begins no phrase.
2. Words grow to pairs. Pairs are counted by 64-bit keys first, which can only count too much; what
   reaches ``least`` is counted again by its words, and scored.
3. Pairs grow to triples. A triple scores no more than ``10**6 * f(u v) / f(u)``, the bound of its
   prefix, nor than ``10**6 * f(v w) / f(w)``. The frontier of pairs is expanded best bound first, in waves that
   grow eightfold: a wave counts the triples whose two bounds reach the wave's limit, and those that hold a pair
   whose own score reaches it, since they decide whether the pair survives. A language is settled
   when ``top`` survivors reach the limit, as what isn't expanded scores less; ties are expanded together.

Every wave reads the documents once; a chunk of MOST_WORDS words at most is counted by numbers of its
own vocabulary, exactly, before anything is shuffled. What a reader has to know of the frontier
travels as bitmaps of keys of MOST_BITS bits at most: a full bitmap lets too much through, which
the counts by words put right, but never too little. Scores are decimals of 38 digits. All counts are
sums, so a phrase in a third of all documents is one row a chunk.

Defined results: a null text is empty; a null lang is ``und``; repeated rows count each; ties go by score,
count, then phrase in byte order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.common import bucket_count, cut_lineage, read_table

LEAST, TOP, COVER = 10, 2_000, 50
SCALE = 1_000_000
MOST_WORDS = 4_000_000
MOST_BITS = 1 << 27
#: Nodes of the first wave for each row that is asked for, and how the waves grow.
FIRST, GROWTH = 8, 8
#: Limits of waves are multiples of this.
LIMIT_STEP = 1_000
#: Fixed: what ends a piece, and a word that can't occur to stand for it.
PIECE_ENDS, END = b".,;:!?\n\x0b\x0c\r", b"."
_TO_END = bytes.maketrans(PIECE_ENDS, b"\n" * len(PIECE_ENDS))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Names(dict):
    """Words to numbers in order of appearance; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def piece_words(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with END after each piece."""
    words = text.lower().translate(_TO_END).replace(b"\n", b" . ").split()
    words.append(END)
    return words


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys ^ (keys >> np.uint64(32))
    keys = keys * _MIX
    return keys ^ (keys >> np.uint64(29))


class Chunk:
    """The words of some documents of one language: ``ids`` in the order of the texts, ``words`` by id."""

    def __init__(self, lang: str, ids: np.ndarray, words: pa.Array, hashes: np.ndarray) -> None:
        self.lang, self.ids, self.words, self.hashes = lang, ids, words, hashes
        self.salt = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))

    def word_keys(self) -> np.ndarray:
        return mixed(self.hashes ^ self.salt)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second words and keys of the distinct pairs, and at each place the number of its pair, or -1."""
        a, b = self.ids[:-1].astype(np.int64), self.ids[1:].astype(np.int64)
        real = np.flatnonzero((a > 0) & (b > 0))
        found, which = np.unique(a[real] << 32 | b[real], return_inverse=True)
        at = np.full(len(a), -1, np.int64)
        at[real] = which
        first, second = found >> 32, found & 0xFFFFFFFF
        return first, second, mixed((self.hashes[first] * _STEP + self.hashes[second]) ^ self.salt), at

    def rows(self, counts: np.ndarray, keys: np.ndarray | None = None, **words: np.ndarray) -> pa.RecordBatch:
        columns = {"lang": pa.array(np.zeros(len(counts), np.int32)), **{name: self.words.take(pa.array(ids)) for name, ids in words.items()}}
        columns["lang"] = pa.DictionaryArray.from_arrays(columns["lang"], pa.array([self.lang])).cast(pa.string())
        if keys is not None:
            columns["key"] = pa.array(keys.view(np.int64))
        return pa.RecordBatch.from_pydict(columns | {"n": pa.array(counts.astype(np.int64))})


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    names, parts, size = Names(), {}, 0

    def made() -> Iterator[Chunk]:
        words = pa.array(list(names), pa.binary()).cast(pa.string())
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        for lang, ids in parts.items():
            yield Chunk(lang, np.concatenate(ids), words, hashes)

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            words = piece_words(text)
            parts.setdefault(lang, []).append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
            size += len(words)
            if size >= MOST_WORDS:
                yield from made()
                names, parts, size = Names(), {}, 0
    if size:
        yield from made()


class Sieve:
    """A set of 64-bit keys as a bitmap of their leading bits; holds every key put in, and perhaps others."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.shift = np.uint64(64 - (len(words) * 64 - 1).bit_length())

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> self.shift
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def make_sieves(keys: DataFrame, *conditions: Column) -> list[Sieve]:
    """Bitmaps of the ``key`` column's rows that meet each condition, 16 bits a row and MOST_BITS at most.
    Spark sets the bits; the driver puts together whole words of 64.
    """
    wanted = 16 * keys.count()
    bits = min(MOST_BITS.bit_length() - 1, max(10, wanted.bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")
    words = keys.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(
        *[F.coalesce(F.bit_or(F.when(c, bit)), F.lit(0).cast("long")).alias(f"s{k}") for k, c in enumerate(conditions)]
    ).toArrow()
    at, made = words["at"].to_numpy(), []
    for k in range(len(conditions)):
        out = np.zeros(1 << (bits - 6), np.uint64)
        out[at] = words[f"s{k}"].to_numpy().view(np.uint64)
        made.append(Sieve(out))
    return made


def counted(docs: DataFrame, count: Callable[[Chunk], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield count(chunk)

    return docs.mapInArrow(run, schema)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, key, n."""

    def count(chunk: Chunk) -> pa.RecordBatch:
        n = np.bincount(chunk.ids, minlength=len(chunk.words))
        n[0] = 0
        used = np.flatnonzero(n)
        return chunk.rows(n[used], chunk.word_keys()[used], word=used)

    rows = counted(docs, count, "lang string, word string, key long, n long")
    return rows.groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, words: Sieve, least: int) -> DataFrame:
    """lang, u, v, key, a of the pairs of ``least`` occurrences or more."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def by_key(chunk: Chunk) -> pa.RecordBatch:
        common = shared.value.holds(chunk.word_keys())
        u, v, keys, at = chunk.pairs()
        kept = common[u] & common[v]
        n = np.bincount(at[at >= 0], minlength=len(u))
        return pa.RecordBatch.from_pydict({"key": pa.array(keys[kept].view(np.int64)), "n": pa.array(n[kept])})

    keys = counted(docs, by_key, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    (sieve,) = make_sieves(cut_lineage(keys), F.lit(True))
    often = docs.sparkSession.sparkContext.broadcast(sieve)

    def by_words(chunk: Chunk) -> pa.RecordBatch:
        u, v, keys, at = chunk.pairs()
        kept = often.value.holds(keys)
        n = np.bincount(at[at >= 0], minlength=len(u))
        return chunk.rows(n[kept], keys[kept], u=u[kept], v=v[kept])

    rows = counted(docs, by_words, "lang string, u string, v string, key long, n long")
    return rows.groupBy("lang", "u", "v").agg(F.first("key").alias("key"), F.sum("n").alias("a")).where(F.col("a") >= least)


def count_triples(docs: DataFrame, sieves: list[Sieve], least: int) -> DataFrame:
    """lang, u, v, w, a of the triples of ``least`` occurrences or more that the wave asks for.
    sieves: of common pairs, of prefixes and suffixes to grow, of pairs to settle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def grow(chunk: Chunk) -> pa.RecordBatch:
        u, v, keys, at = chunk.pairs()
        common, prefix, suffix, settle = (s.holds(keys) & (at.size > 0) for s in shared.value)
        here = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) if len(at) > 1 else np.zeros(0, np.int64)
        a, b = at[here], at[here + 1]
        a, b = (x[common[a] & common[b] & (prefix[a] & suffix[b] | settle[a] | settle[b])] for x in (a, b))
        found, n = np.unique(a << 32 | b, return_counts=True)
        a, b = found >> 32, found & 0xFFFFFFFF
        return chunk.rows(n, u=u[a], v=v[a], w=v[b])

    rows = counted(docs, grow, "lang string, u string, v string, w string, n long")
    return rows.groupBy("lang", "u", "v", "w").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) in decimals."""
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast({SCALE} as decimal(7, 0)) * {whole(a)} * {whole(a)} div ({whole(left)} * {whole(right)})")


def score_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs`` with l, r, score, and the bounds ``forward`` and ``backward`` of what they begin and end."""
    first = words.select("lang", F.col("word").alias("u"), F.col("n").alias("l"))
    second = words.select("lang", F.col("word").alias("v"), F.col("n").alias("r"))
    return pairs.join(first, ["lang", "u"]).join(second, ["lang", "v"]).select(
        "lang", "u", "v", "key", "a", "l", "r", score("a", "l", "r").alias("score"),
        score("a", "a", "l").alias("forward"), score("a", "a", "r").alias("backward"),
    )


def score_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, u, v, w, a with l, r, score of the worse cut, the first of two equal ones."""
    head = pairs.select("lang", "u", "v", F.col("a").alias("head"), F.col("l").alias("f_u"))
    tail = pairs.select("lang", F.col("u").alias("v"), F.col("v").alias("w"), F.col("a").alias("tail"), F.col("r").alias("f_w"))
    both = triples.join(head, ["lang", "u", "v"]).join(tail, ["lang", "v", "w"])
    both = both.withColumns({"one": score("a", "f_u", "tail"), "two": score("a", "head", "f_w")})
    early = F.col("one") <= F.col("two")
    return both.select(
        "lang", "u", "v", "w", "a", F.when(early, F.col("f_u")).otherwise(F.col("head")).alias("l"),
        F.when(early, F.col("tail")).otherwise(F.col("f_w")).alias("r"), F.least("one", "two").alias("score"),
    )


def wave_limits(pairs: DataFrame, nodes: int) -> DataFrame:
    """lang, limit: the bound down to which a language's ``nodes`` best prefixes are expanded (0: all)."""
    step = F.expr(f"forward div {LIMIT_STEP}")
    sizes = pairs.groupBy("lang", step.alias("step")).agg(F.count("*").alias("rows"))
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    enough = F.when(F.col("reached") >= nodes, F.col("step") * LIMIT_STEP)
    return sizes.withColumn("reached", F.sum("rows").over(down)).groupBy("lang").agg(F.coalesce(F.max(enough), F.lit(0)).alias("limit"))


def survivors(nodes: DataFrame, pairs: DataFrame, triples: DataFrame, cover: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates at or above their language's limit that no longer one covers.
    nodes: pairs with their ``limit``.
    """
    limits = nodes.select("lang", "limit").distinct()
    inner = triples.select("lang", "a", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("p"))
    inner = inner.groupBy("lang", "p.u", "p.v").agg(F.max("a").alias("longer"))
    twos = nodes.where("score >= limit").join(inner, ["lang", "u", "v"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    threes = score_triples(triples, pairs).join(limits, "lang").where("score >= limit")
    return twos.select("lang", F.concat_ws(" ", "u", "v").alias("phrase"), "a", "l", "r", "score").unionByName(
        threes.select("lang", F.concat_ws(" ", "u", "v", "w").alias("phrase"), "a", "l", "r", "score")
    )


def best_rows(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each lang with their ``rank``. What scores below the top-th row goes by a histogram of
    scores first, and ties are cut down within salted parts, so that no task sorts a whole language.
    """
    sizes = rows.groupBy("lang", "score").agg(F.count("*").alias("rows"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    sizes = sizes.withColumn("reached", F.sum("rows").over(down))
    floor = sizes.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached") >= top, F.col("score"))), F.lit(0)).alias("_floor"))
    kept = cut_lineage(rows.join(floor, "lang").where("score >= _floor").drop("_floor"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(bucket_count(kept.count())))
    part = Window.partitionBy("lang", "_salt").orderBy(*order)
    kept = kept.withColumn("_salt", salt).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("_salt")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of each language. A phrase goes when a longer one
    of ``least`` occurrences holds it and has ``cover`` hundredths of its occurrences or more.
    """
    docs = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = cut_lineage(count_words(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.where(F.col("n") >= least)
    (sieve,) = make_sieves(common, F.lit(True))
    pairs = cut_lineage(count_pairs(docs, sieve, least))
    pairs = cut_lineage(score_pairs(pairs, common))
    open_pairs, done, nodes_asked = pairs, None, FIRST * top
    while True:
        nodes = cut_lineage(open_pairs.join(wave_limits(open_pairs, nodes_asked), "lang"))
        reach = lambda c: F.col(c) >= F.col("limit")
        sieves = make_sieves(nodes, F.lit(True), reach("forward"), reach("backward"), reach("score"))
        triples = cut_lineage(count_triples(docs, sieves, least))
        found = cut_lineage(survivors(nodes, pairs, triples, cover))
        state = nodes.groupBy("lang").agg(F.first("limit").alias("limit")).join(found.groupBy("lang").agg(F.count("*").alias("rows")), "lang", "left")
        short = cut_lineage(state.where((F.col("limit") > 0) & (F.coalesce("rows", F.lit(0)) < top)).select("lang"))
        settled = found.join(short, "lang", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if short.isEmpty():
            break
        open_pairs = cut_lineage(open_pairs.join(short, "lang", "left_semi"))
        nodes_asked *= GROWTH
    return best_rows(done, top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts),
ws AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
grams AS (
  SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS s FROM ws, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[s:s + k - 1] AS g, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, b.cut, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a * c.a) // (x.a * y.a) AS score
  FROM cand c JOIN (VALUES (1), (2)) AS b(cut) ON b.cut < c.k
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:b.cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[b.cut + 1:c.k]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, g, max(a) AS a FROM (SELECT lang, g[1:2] AS g, a FROM cand WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM cand WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.g = s.g WHERE s.k = 3 OR o.a IS NULL OR 100 * o.a < {COVER} * s.a),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""

QUERIES = {"op12_phrases": op12_phrases}
ORACLE_SQL = {"op12_phrases": OP12_SQL}
