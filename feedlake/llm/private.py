"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

Four patterns give the base spans. The field finds what they miss, such as addresses spelt with
"at" and "dot" or numbers without a leading plus: every token has a shape (case and length of
letters, length of digits, the sign itself, whether space stands before it) or, if it is a word
frequent inside labelled spans, a name of its own. The score of a labelling sums weights of the shapes
within REACH tokens and of neighbouring labels (O or a kind; a span is a stretch of one kind).

Training takes a small labelled table (text, spans). ``label_by_patterns`` derives one from the corpus
itself: windows around base spans of at most MAX_DOCS documents, once as they are, in
disguises (the same data written another way, still labelled) and with look-alikes (dates, versions,
amounts, no label) in place of the span. At most MAX_WINDOWS windows of WINDOW tokens are kept, by hash; one task
fits them by gradient ascent of the likelihood (forward-backward over numpy batches).

Decoding is Viterbi in numpy batches over whole texts, in the scan. A token is O on every best path
if no stretch of one kind around it, with the most that links can add, reaches the score of O in its place;
so texts fall into short stretches that are decoded side by side, and that is exact. Found spans that overlap a base span go, as do those that
cannot be what they are called (an address of four numbers up to 255, a card number by its check digit,
7 to 15 digits of a phone number); what stays has the kinds ``crf_email``, ``crf_ip``, ``crf_card``, ``crf_phone``.

Defined results: a null or blank text has no spans; null ids are kept; repeated rows are reported each;
without any base span to learn from there are base spans only; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import cut_lineage, read_table
from feedlake.llm.toxicity import Remembered

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = KINDS + tuple(f"crf_{k}" for k in KINDS)
#: Bounds of what the field is fitted on.
MAX_DOCS, MAX_WINDOWS, WINDOW = 2_000, 6_000, 41
REACH, MAX_CUES, MIN_SEEN, MIN_CUE = 3, 200, 3, 25
#: A word is a cue if this share of its occurrences lies in labelled spans.
CUE_SHARE = 0.2
EPOCHS, STEP, SHRINK = 12, 0.25, 2e-4
CHUNK_TOKENS, VITERBI_TOKENS = 200_000, 100_000
#: Characters of context on either side of a labelled span.
CONTEXT = 70

#: The contract's patterns, written so that a run is entered at its first character only.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Whether a text is worth labelling; no span is without one of these.
MARKS = r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]{4}[\x20-]?[0-9]{4}"

#: Spellings of the signs of an address.
AT = re.compile(r"\s*(?:[\[(]\s*(?:at|@)\s*[\])]|\bat\b|@)\s*", re.I)
DOT = re.compile(r"\s*(?:[\[(]\s*(?:dot|\.)\s*[\])]|\bdot\b|\.)\s*", re.I)

#: A token with the space before it; the tokens of a text cover it up to trailing space.
TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)")

Span = tuple[int, int, int]


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, index of the kind, end), by start, then kind."""
    found, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            free = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 4 or not p[:-3].strip("0") for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def shape(token: str) -> str:
    """The class of a token by its form: what stands before it, then letters, digits or a sign."""
    core = token.lstrip()
    size = len(core)
    before = "" if size == len(token) else "\n" if "\n" in token[:-size] else " "
    if core.isdecimal():
        return f"{before}d{min(size, 20)}{'s' if size <= 3 and int(core) <= 255 else ''}"
    if size > 1 or core.isalpha():
        case = "x" if core.islower() else "X" if core.isupper() else "Xx" if core[1:].islower() else "xX"
        return f"{before}{case}{min(size, 4) if size < 7 else 5}"
    return before + (core if core.isascii() else "~")


def cue(token: str) -> str:
    """The name by which a short word may have weights of its own ("" for others)."""
    core = token.lstrip()
    return core.lower() if core[0].isalpha() and len(core) <= 12 else ""


class Field:
    """The fitted field. classes: name to row of the weights (0: unknown, 1: beyond the text);
    weights[k, class, kind]: of a token whose k-th neighbour (from -REACH) has the class, against O; links: from label to label.
    """

    def __init__(self, classes: dict[str, int], cues: set[str], weights: np.ndarray, bias: np.ndarray, links: np.ndarray) -> None:
        self.classes, self.cues, self.weights, self.bias, self.links = classes, cues, weights, bias, links
        #: What a stretch of one kind has of its links at most, against O: inside for each token, and at its ends.
        own = np.diag(links)[1:]
        self.inside = own - links[0, 0]
        into, out = links[:, 1:] - links[:, :1], (links[1:, :] - links[0]).T
        other = ~np.eye(len(links), dtype=bool)[:, 1:]
        self.ends = np.where(other, into, -np.inf).max(0) + np.where(other, out, -np.inf).max(0) - self.inside

    def row(self, token: str) -> int:
        name = cue(token)
        return self.classes.get(f"w:{name}" if name in self.cues else shape(token), 0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of the kinds against O; ``rows`` has REACH rows more at both ends."""
        n = len(rows) - 2 * REACH
        out = np.tile(self.bias, (n, 1))
        for k in range(2 * REACH + 1):
            out += self.weights[k][rows[k : k + n]]
        return out

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of stretches of one length between tokens labelled O: scores[stretch, place, kind]."""
        n, size, _ = scores.shape
        emit = np.concatenate([np.zeros((n, size, 1), scores.dtype), scores], 2)
        best = self.links[0] + emit[:, 0]
        came = np.zeros((n, size, emit.shape[2]), np.int8)
        for t in range(1, size):
            ways = best[:, :, None] + self.links
            came[:, t] = ways.argmax(1)
            best = ways.max(1) + emit[:, t]
        labels = np.zeros((n, size), np.int8)
        labels[:, -1] = (best + self.links[:, 0]).argmax(1)
        for t in range(size - 1, 0, -1):
            labels[:, t - 1] = came[np.arange(n), t, labels[:, t]]
        return labels

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Labels (0: O) of the tokens of texts laid side by side with REACH rows of class 1 around each."""
        scores = self.scores(rows)
        # of each kind the best stretch that ends, or begins, at a place: sums since, or until, the least running sum
        bound = np.where(rows[REACH : len(rows) - REACH, None] == 1, -1e4, scores.astype(np.float64) + self.inside)
        sums = np.concatenate([np.zeros((1, bound.shape[1])), np.cumsum(bound, 0)])
        here = sums[1:] - np.minimum.accumulate(sums[:-1], 0)
        onward = np.maximum.accumulate(sums[:0:-1], 0)[::-1] - sums[:-1]
        open_ = np.concatenate([[False], (here + onward - bound + self.ends >= -1e-3).any(1), [False]])
        edges = np.flatnonzero(open_[1:] != open_[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        labels = np.zeros(len(scores), np.int8)
        order = np.argsort(sizes, kind="stable")
        sizes, starts = sizes[order], starts[order]
        padded = np.concatenate([scores, np.full((1, scores.shape[1]), -1e4, scores.dtype)])
        lo = 0
        while lo < len(sizes):
            hi = int(np.searchsorted(sizes, 1.25 * sizes[lo] + 1, "right"))
            hi = min(hi, lo + max(1, VITERBI_TOKENS // int(sizes[hi - 1])))
            size = np.arange(sizes[hi - 1])
            where = np.where(size < sizes[lo:hi, None], starts[lo:hi, None] + size, len(scores))  # beyond its end a stretch is O
            real = where < len(scores)
            labels[where[real]] = self.viterbi(padded[where])[real]
            lo = hi
        return labels


def plausible(kind: int, text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    if kind == 0:
        address = base_spans(DOT.sub(".", AT.sub("@", text)))
        return len(address) == 1 and address[0][0] == 0 and len(AT.findall(text)) == 1
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and passes_luhn(digits)
    return 7 <= len(digits) <= 15


def chunk_spans(texts: list[str], field: Field, known: Remembered) -> list[list[Span]]:
    """The field's spans of each text, by start."""
    tokens = [TOKEN.findall(t) for t in texts]
    edge = np.ones(REACH, np.int16)
    parts = [edge]
    for words in tokens:
        parts += [np.fromiter(map(known.__getitem__, words), np.int16, len(words)), edge]
    labels = field.decode(np.concatenate(parts))
    found, at = [], 0
    for text, words in zip(texts, tokens):
        own = labels[at : at + len(words)]
        at += len(words) + REACH
        spans = []
        if own.any():
            ends = list(accumulate(map(len, words)))
            cuts = np.flatnonzero(np.diff(own, prepend=np.int8(0), append=np.int8(0)))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                kind = int(own[lo]) - 1
                start, end = ends[lo] - len(words[lo].lstrip()), ends[hi - 1]
                if kind >= 0 and plausible(kind, text[start:end]):
                    spans.append((start, len(KINDS) + kind, end))
        found.append(spans)
    return found


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans and those of ``more`` that overlap none, by start, then kind."""
    if not more:
        return base
    reach, out = [0, *accumulate((e for _, _, e in base), max)], list(base)
    starts = [s for s, _, _ in base]
    for s, k, e in more:
        before = int(np.searchsorted(starts, e))  # of these the furthest end decides
        if reach[before] <= s:
            out.append((s, k, e))
    return sorted(out)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def expected_counts(emit: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z of each row of emit[row, place, label], the labels' chances at each place, and the links' expected counts.
    A label O stands before and after each row.
    """
    n, size, kinds = emit.shape
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    ahead[:, 0] = links[0] + emit[:, 0]
    for t in range(1, size):
        ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + links, 1) + emit[:, t]
    behind[:, -1] = links[:, 0]
    for t in range(size - 2, -1, -1):
        behind[:, t] = log_sum(links + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    z = log_sum(ahead[:, -1] + links[:, 0], 1)
    chances = np.exp(ahead + behind - z[:, None, None])
    pairs = np.exp(ahead[:, :-1, :, None] + links + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
    pairs[0] += chances[:, 0].sum(0)
    pairs[:, 0] += chances[:, -1].sum(0)
    return z, chances, pairs


def fit_field(shapes: list[list[str]], cues: list[list[str]], labels: list[list[int]], seed: int = 5) -> Field:
    """Fits by AdaGrad over mini-batches; rows are padded by tokens beyond the text, labelled O."""
    inside: dict[str, int] = {}
    everywhere: dict[str, int] = {}
    for row, names in zip(labels, cues):
        for name, label in zip(names, row):
            if name:
                everywhere[name] = everywhere.get(name, 0) + 1
                inside[name] = inside.get(name, 0) + (label > 0)
    often = [c for c, n in inside.items() if n >= MIN_CUE and n >= CUE_SHARE * everywhere[c]]
    chosen = set(sorted(often, key=lambda c: (-inside[c], c))[:MAX_CUES])
    named = [[f"w:{c}" if c in chosen else s for s, c in zip(a, b)] for a, b in zip(shapes, cues)]
    seen: dict[str, int] = {}
    for row in named:
        for name in row:
            seen[name] = seen.get(name, 0) + 1
    classes = {name: k + 2 for k, name in enumerate(sorted(c for c, n in seen.items() if n >= MIN_SEEN))}
    n, c, kinds = len(named), len(classes) + 2, len(KINDS) + 1
    rows = np.ones((n, WINDOW + 2 * REACH), np.int16)
    gold = np.zeros((n, WINDOW), np.int64)
    for k, (row, own) in enumerate(zip(named, labels)):
        rows[k, REACH : REACH + len(row)] = [classes.get(name, 0) for name in row]
        gold[k, : len(own)] = own
    params = [np.zeros((2 * REACH + 1, c, kinds - 1)), np.full(kinds - 1, -2.0), np.zeros((kinds, kinds))]
    sums = [np.full(p.shape, 1e-4) for p in params]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            batch = order[lo : lo + 64]
            x, y = rows[batch], gold[batch]
            weights, bias, links = params
            emit = np.zeros((len(batch), WINDOW, kinds))
            emit[..., 1:] = bias
            for k in range(2 * REACH + 1):
                emit[..., 1:] += weights[k][x[:, k : k + WINDOW]]
            _, chances, pairs = expected_counts(emit, links)
            miss = (np.eye(kinds)[y] - chances)[..., 1:] / len(batch)
            up = np.zeros_like(weights)
            for k in range(2 * REACH + 1):
                np.add.at(up[k], x[:, k : k + WINDOW].ravel(), miss.reshape(-1, kinds - 1))
            up[:, 0] = 0
            held = np.pad(y, ((0, 0), (1, 1)))
            real = np.zeros((kinds, kinds))
            np.add.at(real, (held[:, :-1].ravel(), held[:, 1:].ravel()), 1)
            for p, s, g in zip(params, sums, (up - SHRINK * weights, miss.sum((0, 1)), (real - pairs) / len(batch) - SHRINK * links)):
                s += g * g
                p += STEP * g / np.sqrt(s)
    weights, bias, links = params
    return Field(classes, chosen, weights.astype(np.float32), bias.astype(np.float32), links.astype(np.float32))


def windows_of(text: str, spans: list[Span]) -> Iterator[tuple[list[str], list[str], list[int]]]:
    """A labelled text's tokens in windows of WINDOW: shapes, cues and labels. A token that begins in a span has its label."""
    tokens = TOKEN.findall(text)
    ends = list(accumulate(map(len, tokens)))
    labels, k = [], 0
    spans = sorted(spans)
    for token, end in zip(tokens, ends):
        start = end - len(token.lstrip())
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        labels.append(spans[k][1] + 1 if k < len(spans) and spans[k][0] <= start else 0)
    for lo in range(0, len(tokens), WINDOW):
        part = tokens[lo : lo + WINDOW]
        yield [shape(t) for t in part], [cue(t) for t in part], labels[lo : lo + WINDOW]


def train_field(labelled: DataFrame, most: int = MAX_WINDOWS) -> Field | None:
    """Fits a labelled table: text, and spans (structs of start, kind_no, end in code points). None if it has no spans.
    ``most`` bounds the windows, ``WINDOW`` their tokens.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [w for text, spans in zip(batch["text"], batch["spans"]) for w in windows_of(text or "", [(s["start"], s["kind_no"], s["end"]) for s in spans])]
            yield pd.DataFrame(rows, columns=["shapes", "cues", "labels"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["shapes", "cues", "labels"]), *batches], ignore_index=True)
        if not any(map(any, rows["labels"])):
            return
        rows = rows.loc[rows.apply(lambda r: (tuple(r["shapes"]), tuple(r["cues"]), tuple(r["labels"])), axis=1).argsort(kind="stable")]
        f = fit_field(*[[list(x) for x in rows[c]] for c in ("shapes", "cues", "labels")])
        yield pd.DataFrame({"classes": [list(f.classes)], "cues": [sorted(f.cues)], "weights": [f.weights.ravel().tolist()], "bias": [f.bias.tolist()], "links": [f.links.ravel().tolist()]})

    # texts without tokens are left out of the table of windows
    parts = labelled.select("text", "spans").mapInPandas(cut, "shapes array<string>, cues array<string>, labels array<int>")
    name = F.xxhash64("shapes", "cues", "labels")
    parts = cut_lineage(parts.withColumn("_name", name).orderBy("_name").limit(most).drop("_name"))
    # bounded rows of bounded size: one task fits them, away from the driver
    made = parts.coalesce(1).mapInPandas(fit, "classes array<string>, cues array<string>, weights array<float>, bias array<float>, links array<float>").collect()
    if not made:
        return None
    f, kinds = made[0], len(KINDS) + 1
    classes = {name: k + 2 for k, name in enumerate(f["classes"])}
    weights = np.array(f["weights"], np.float32).reshape(2 * REACH + 1, len(classes) + 2, kinds - 1)
    return Field(classes, set(f["cues"]), weights, np.array(f["bias"], np.float32), np.array(f["links"], np.float32).reshape(kinds, kinds))


def in_disguise(kind: int, value: str, rng: np.random.Generator) -> str:
    """The same personal data in another spelling, one that the patterns don't match."""
    pick = lambda *ways: ways[rng.integers(len(ways))]
    digits = NOT_DIGIT.sub("", value)
    if kind == 0:
        user, _, host = value.partition("@")
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), (" at ", "."), (" AT ", " DOT "))
        return user + at + host.replace(".", dot)
    if kind == 1:
        return value.replace(".", pick(" . ", "[.]", " dot ", "-", "(.)"))
    if kind == 2:
        return pick(".", "/", "  ", "_", " - ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    last = digits[-10:]
    head = pick("", "1-", "0", "001 ", "00 1 ")
    return head + pick(f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}/{last[3:6]}/{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}", f"{last[:3]} {last[3:6]} {last[6:]}")


def look_alike(rng: np.random.Generator) -> str:
    """What isn't personal data but has its shapes."""
    n = lambda lo, hi: int(rng.integers(lo, hi))
    ways = (
        f"{n(1900, 2030)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2030)}", f"{n(0, 24)}:{n(0, 60):02}:{n(0, 60):02}",
        f"v{n(0, 20)}.{n(0, 40)}.{n(0, 99)}", f"{n(0, 9)}.{n(1000, 99999)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}", f"{n(10**5, 10**9)}", f"{n(10**15, 10**16)}",
        f"+{n(1, 99)} %", f"at {n(1, 24)} . then", f"{rng.bytes(16).hex()}", f"{rng.bytes(4).hex()} {rng.bytes(4).hex()}", f"#{n(1, 10**6)}", f"{n(1, 99)} - {n(1, 99)} - {n(1, 99)}", f"look at it . it is", f"{n(1, 99)} {n(100, 999)} {n(1, 9)}",
    )
    return ways[rng.integers(len(ways))]


def examples(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Labelled pieces of a text: each base span with its surroundings as it is, twice in disguise, once with a
    look-alike in its place; and one piece from anywhere.
    """
    spans = base_spans(text)
    for start, kind, end in spans:
        lo, hi = max(0, start - CONTEXT), end + CONTEXT
        before, after = text[lo:start], text[end:hi]
        yield text[lo:hi], base_spans(text[lo:hi])
        rng = np.random.default_rng(zlib.crc32(f"{start} {text[lo:hi]}".encode()))
        for value, label in ((in_disguise(kind, text[start:end], rng), True), (in_disguise(kind, text[start:end], rng), True), (look_alike(rng), False)):
            piece = before + value + after
            around = [s for s in base_spans(piece) if s[2] <= start - lo or s[0] >= start - lo + len(value)]
            yield piece, around + [(start - lo, kind, start - lo + len(value))] * label
    at = zlib.crc32(text.encode()) % max(1, len(text) - 2 * CONTEXT)
    piece = text[at : at + 2 * CONTEXT]
    yield piece, base_spans(piece)


_SPANS = "array<struct<start:int,kind_no:int,end:int>>"


def _structs(spans: list[Span]) -> list[dict]:
    return [{"start": s, "kind_no": k, "end": e} for s, k, e in spans]


def label_by_patterns(docs: DataFrame, most: int = MAX_DOCS) -> DataFrame:
    """A labelled table (text, spans) from the documents of at most ``most`` ids, taken by hash from those with a mark of personal data."""
    chosen = (
        docs.where(F.col("text").rlike(MARKS) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                rows = list(examples(text))
                for lo in range(0, len(rows), 2_000):
                    yield pd.DataFrame([(t, _structs(s)) for t, s in rows[lo : lo + 2_000]], columns=["text", "spans"])

    rows = docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull()).select("text")
    return rows.mapInPandas(label, f"text string, spans {_SPANS}")


def find_private(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id and ``spans`` for every row: structs of start, kind_no, end (code points, end exclusive) and kind,
    by start, then kind. field: None for the patterns alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known = Remembered(model.row) if model else None
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].tolist()
            more: list[list[Span]] = []
            held, size = [], 0
            for text in texts if model else ():
                held.append(text)
                size += len(text)
                if size > 5 * CHUNK_TOKENS:
                    more += chunk_spans(held, model, known)
                    held, size = [], 0
            if held:
                more += chunk_spans(held, model, known)
            spans = [_structs(merged(base_spans(t), m)) for t, m in zip(texts, more or [[]] * len(texts))]
            yield pd.DataFrame({"doc_id": ids.astype("Int64"), "spans": spans})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = F.array(*map(F.lit, ALL_KINDS))
    found = rows.mapInPandas(search, f"doc_id long, spans {_SPANS}")
    named: Callable = lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), F.get(kinds, s["kind_no"]).alias("kind"))
    return found.select("doc_id", F.transform("spans", named).alias("spans"))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_private(docs, train_field(label_by_patterns(docs)))
    base = F.filter("spans", lambda s: s["kind_no"] < len(KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op11_private": op11_private}
ORACLE_SQL: dict[str, str] = {}
