"""Near words by a deletion neighbourhood: an equi-join instead of a comparison of all words of similar length.

Two words within d edits (insertions, deletions, substitutions, swaps of neighbours) become equal once up to d
characters are left out of each: a substitution leaves out one on either side, and so does a swap. Words of
up to DELETED_UP_TO characters meet by these keys. Longer ones are cut into 2 * d + 1 segments, of which d edits
leave one as it is, moved by d places at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_EDITS = 2
DELETED_UP_TO = 24
SEGMENTS = 2 * MOST_EDITS + 1


def without_one(word: Column) -> Column:
    """The distinct words with one character left out."""
    places = F.sequence(F.lit(1), F.length(word))
    cut = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def deletion_keys(word: Column, most: Column) -> Column:
    """Structs (left_out, key) for up to ``most`` (1 or 2) characters left out."""
    one = without_one(word)
    two = F.array_distinct(F.flatten(F.transform(one, without_one)))
    keys = lambda n, words: F.transform(words, lambda w: F.struct(F.lit(n).alias("left_out"), w.alias("key")))
    none = F.array().cast("array<struct<left_out:int,key:string>>")
    return F.concat(keys(0, F.array(word)), keys(1, one), F.when(most >= 2, keys(2, two)).otherwise(none))


def _segment(length: Column, i: Column) -> tuple[Column, Column]:
    """First character (from 1) and size of the i-th of SEGMENTS parts of a word of that length."""
    start = F.floor(length * i / SEGMENTS).cast("int")
    return start + 1, F.floor(length * (i + 1) / SEGMENTS).cast("int") - start


def segment_keys(word: Column) -> Column:
    """Structs (length, part, key) of a word's own segments."""
    def one(i: Column) -> Column:
        start, size = _segment(F.length(word), i)
        return F.struct(F.length(word).alias("length"), i.alias("part"), F.substring(word, start, size).alias("key"))

    return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), one)


def moved_segment_keys(word: Column) -> Column:
    """Structs (length, part, key) of what could be the segments of a word of up to MOST_EDITS characters more or less."""
    def of_length(length: Column) -> Column:
        def of_part(i: Column) -> Column:
            start, size = _segment(length, i)
            moved = F.filter(F.transform(F.sequence(F.lit(-MOST_EDITS), F.lit(MOST_EDITS)), lambda m: start + m), lambda p: p >= 1)
            return F.transform(moved, lambda p: F.struct(length.alias("length"), i.alias("part"), F.substring(word, p, size).alias("key")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), of_part))

    lengths = F.sequence(F.length(word) - MOST_EDITS, F.length(word) + MOST_EDITS)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two words, a swap of neighbours counting as one and no part edited twice: the rows of
    the usual table, of which the last two are kept.
    """
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: j)
    char = lambda w, i: F.substring(w, i, F.lit(1))

    def next_row(state: Column, i: Column) -> Column:
        before, last = state["before"], state["last"]

        def cell(row: Column, j: Column) -> Column:
            plain = F.least(
                F.get(last, j) + 1, F.get(row, j - 1) + 1, F.get(last, j - 1) + F.when(char(a, i) == char(b, j), 0).otherwise(1),
            )
            swapped = (i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j))
            return F.array_append(row, F.when(swapped, F.least(plain, F.get(before, j - 2) + 1)).otherwise(plain))

        row = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell)
        return F.struct(last.alias("before"), F.when(F.length(b) > 0, row).otherwise(F.array(i)).alias("last"))

    start = F.struct(first.alias("before"), first.alias("last"))
    rows = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, next_row, lambda s: F.element_at(s["last"], -1))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(rows)


def near_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, most, d, columns of ``words``): the words within ``most`` edits of each token. tokens: token, most (0 to 2),
    one row a token; words: word and others, one row a word.
    """
    size = F.length("token")
    short = tokens.where((size <= DELETED_UP_TO) & (F.col("most") > 0)).select("token", "most", F.explode(deletion_keys(F.col("token"), F.col("most"))).alias("k"))
    kept = words.where(F.length("word") <= DELETED_UP_TO + MOST_EDITS)
    # a word of fewer than 6 characters is within two edits of no token that may have two
    levels = F.when(F.length("word") >= 4 * MOST_EDITS - MOST_EDITS, 2).otherwise(1)
    listed = kept.select("word", F.explode(deletion_keys(F.col("word"), levels)).alias("k")).select("word", F.col("k.key").alias("key"), F.col("k.left_out").alias("out"))
    met = short.select("token", "most", "k.key", "k.left_out").join(listed, "key").where("out <= most")
    long = tokens.where((size > DELETED_UP_TO) & (F.col("most") > 0)).select("token", "most", F.explode(segment_keys(F.col("token"))).alias("k"))
    others = words.where(F.length("word") > DELETED_UP_TO - MOST_EDITS).select("word", F.explode(moved_segment_keys(F.col("word"))).alias("k"))
    far = long.select("token", "most", "k.*").join(others.select("word", "k.*"), ["length", "part", "key"])
    pairs = met.select("token", "most", "word").unionByName(far.select("token", "most", "word")).distinct()
    bound = F.levenshtein("token", "word", 2 * MOST_EDITS) >= 0  # a swap is two plain edits, so nothing near is lost
    close = pairs.where(bound).withColumn("d", edit_distance(F.col("token"), F.col("word"))).where("d <= most")
    return close.join(words, "word")
