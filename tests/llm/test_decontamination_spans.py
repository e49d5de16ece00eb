"""The text that is left when spans are removed, and items without an id."""

import re

from feedlake.llm import decontamination

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cut(text, items):
    """The text without the words that lie in a window of an item; what stands between words stays."""
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, gone = low(text), set()
    for item in map(low, items):
        n = min(10, len(item))
        for s in range(len(item) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == item[s : s + n]:
                    gone |= set(range(k, k + n))
    if not gone:
        return text
    out, k = [], 0
    for part in re.split(f"({SEPARATOR})", text):
        if not part:
            continue
        if re.match(SEPARATOR, part):
            out.append(part)
        else:
            out.append("" if k in gone else part)
            k += 1
    return "".join(out)


def test_spans_are_cut_out_of_the_text(spark):
    items = ["One two three", "a b c d e f g h i j k", None, "..."]
    texts = [
        "one TWO, three! and four", "  zero one two three", "x a b c d e f g h i j y", "x A b c d e f g h i j k, one two three.", "nothing here", "", None, "--- one two three ---",
        "one two three", "one two  one two three one two three", "a b c d e f g h i", "Été one\ttwo\nthree été",
    ]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, hit string")
    out = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, "spans").collect()}
    assert out == {i: cut(t, items) for i, t in enumerate(texts)}


def test_an_item_without_an_id_hits_words_but_is_not_listed(spark):
    bench = spark.createDataFrame([(None, "one two three"), (2, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three")], "doc_id long, text string")
    out = {r["doc_id"]: (list(r["hit"]), list(r["items"])) for r in decontamination.find_hits(docs, bench).collect()}
    assert out == {1: ([1, 2, 3, 4, 5], ["2"]), 2: ([1, 2, 3], [])}
