"""Base spans against the contract's patterns, the random field against enumeration, and found disguises."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedlake.llm import private

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def by_patterns(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else False, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[kind]
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=1_500, deadline=None)
@given(st.text(alphabet="ab@@..-+ 0112459()\né", max_size=40))
def test_base_spans(text):
    assert private.base_spans(text) == by_patterns(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "378282246310005", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "+1 (499) 555-6503", "a.b@c.d-e.f", "@", ".", " ", "-", "x", "0", "+44"]), max_size=8))
def test_base_spans_of_joined_data(parts):
    text = "".join(parts)
    assert private.base_spans(text) == by_patterns(text)


def random_field(seed, classes=6):
    rng = np.random.default_rng(seed)
    kinds = len(private.KINDS) + 1
    names = {f"c{k}": k + 2 for k in range(classes - 2)}
    return private.Field(
        names, set(), rng.normal(0, 2, (2 * private.REACH + 1, classes, kinds - 1)).astype(np.float32),
        rng.normal(-2, 1, kinds - 1).astype(np.float32), rng.normal(0, 1.5, (kinds, kinds)).astype(np.float32),
    )


def best_path(emit, links):
    def total(path):
        return sum(emit[t, y] for t, y in enumerate(path)) + sum(links[a, b] for a, b in zip((0, *path), (*path, 0)))

    return max(itertools.product(range(emit.shape[1]), repeat=len(emit)), key=total)


@pytest.mark.parametrize("seed", range(12))
def test_decode_equals_enumeration(seed):
    field, rng = random_field(seed), np.random.default_rng(seed + 100)
    texts = [rng.integers(0, 6, n) for n in (1, 2, 3, 5, 6)]
    texts = [np.where(t == 1, 0, t) for t in texts]
    edge = np.ones(private.REACH, np.int64)
    rows = np.concatenate([edge, *[x for t in texts for x in (t, edge)]])
    got, at = field.decode(rows), 0
    for t in texts:
        own = rows[at : at + len(t) + 2 * private.REACH]
        emit = np.concatenate([np.zeros((len(t), 1)), field.scores(own)], 1)
        assert tuple(got[at : at + len(t)]) == best_path(emit, field.links)
        at += len(t) + private.REACH


def test_cut_texts_decode_as_whole_ones(monkeypatch):
    """A long text with rare spans: the stretches give what one Viterbi pass over everything gives."""
    field, rng = random_field(3), np.random.default_rng(1)
    field.bias -= 6
    rows = np.concatenate([np.ones(3, np.int64), rng.integers(2, 6, 4_000), np.ones(3, np.int64)])
    whole = field.viterbi(field.scores(rows)[None])[0]
    seen = []
    plain = private.Field.viterbi
    monkeypatch.setattr(private.Field, "viterbi", lambda self, s: seen.append(s.shape[1]) or plain(self, s))
    assert (field.decode(rows) == whole).all() and 0 < (whole > 0).sum() and max(seen) < 2_000


def test_expected_counts_equal_enumeration():
    rng = np.random.default_rng(2)
    emit, links = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    z, chances, pairs = private.expected_counts(emit, links)
    want = np.zeros((3, 3))
    for n in range(2):
        weight = {p: np.exp(sum(emit[n, t, y] for t, y in enumerate(p)) + sum(links[a, b] for a, b in zip((0, *p), (*p, 0)))) for p in itertools.product(range(3), repeat=4)}
        assert np.isclose(z[n], np.log(sum(weight.values())))
        for p, w in weight.items():
            for a, b in zip((0, *p), (*p, 0)):
                want[a, b] += w / sum(weight.values())
        for t, y in itertools.product(range(4), range(3)):
            assert np.isclose(chances[n, t, y], sum(w for p, w in weight.items() if p[t] == y) / sum(weight.values()))
    assert np.allclose(pairs, want)


FILL = "the report of our team on water and stone was read by many people who came to see it at noon . then they left"


def sentence(rng, value):
    words = FILL.split()
    rng.shuffle(words)
    return " ".join(words[:12]) + " " + value + " " + " ".join(words[12:])


def value(rng, kind):
    n = lambda lo, hi: int(rng.integers(lo, hi))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), n(3, 9)))
    if kind == 0:
        return f"{word()}.{word()}@{word()}.{rng.choice(['com', 'org', 'net'])}"
    if kind == 1:
        return ".".join(str(n(0, 256)) for _ in range(4))
    if kind == 2:
        body = "4" + "".join(str(n(0, 10)) for _ in range(14))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    return f"+1 ({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, sentence(rng, value(rng, i % 4))) for i in range(800)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def field(docs):
    return private.train_field(private.label_by_patterns(docs))


def test_disguised_data_of_unseen_texts_are_found(spark, field):
    rng, rows, want = np.random.default_rng(99), [], {}
    for i in range(400):
        plain = value(rng, i % 4)
        hidden = private.in_disguise(i % 4, plain, rng)
        text = sentence(rng, hidden)
        if not by_patterns(text):
            want[i] = (text.index(hidden), i % 4 + 4, text.index(hidden) + len(hidden))
        rows.append((i, text))
    clean = [(1_000 + i, sentence(rng, private.look_alike(rng))) for i in range(400)]
    found = {r["doc_id"]: [(s["start"], s["kind_no"], s["end"]) for s in r["spans"]] for r in private.find_private(spark.createDataFrame(rows + clean, "doc_id long, text string"), field).collect()}
    hit = [k for k in want if want[k] in found[k]]
    assert len(hit) >= 0.9 * len(want)
    assert sum(any(k >= 4 for _, k, _ in found[i]) for i, _ in clean) <= 8


def test_training_is_bounded(spark, docs):
    many = docs.union(spark.createDataFrame([(3, "mail me at first.last@example.com now")] * 3_000, docs.schema))
    labelled = private.label_by_patterns(many)
    assert labelled.count() > 3_000
    assert private.train_field(labelled, 40) is not None
    again = [private.train_field(private.label_by_patterns(docs, 100), 200) for _ in range(2)]
    assert (again[0].weights == again[1].weights).all()


def test_query_on_awkward_rows(spark, docs, tmp_path):
    long = ["1" * 200_000, "x" * 200_000, "1.1." * 50_000, "a@" * 50_000, "+1 (" * 50_000, "1 " * 100_000, "a@b.c," * 20_000]
    rows = [(1_000, None), (1_001, ""), (1_002, " \n"), (None, "me@here.org"), (None, None), (1_003, "é漢 me@here.org 𝒳 1.2.3.4"), (5, "twice 4111 1111 1111 1111")]
    rows += [(2_000 + k, t) for k, t in enumerate(long)] + [(5, "twice 4111 1111 1111 1111")]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema)).selectExpr("*", "'x' AS spans", "1 AS n_email", "text AS kind")
    both.write.parquet(f"{tmp_path}/full/documents.parquet")
    both.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    began = time.time()
    found = private.op11_private(spark, f"{tmp_path}/full").collect()
    assert time.time() - began < 600  # quadratic work would take hours
    texts = sorted(((r["doc_id"], r["text"]) for r in both.collect()), key=str)
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in texts)
    listed = lambda spans: ",".join(f"{private.ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, text in texts:
        if i is not None and text is not None and len(text) < 1_000:
            base = by_patterns(text)
            want = hashlib.sha256(listed(base).encode()).hexdigest()
            assert want in {r["base_sha256"] for r in by_id[i]}
            row = next(r for r in by_id[i] if r["base_sha256"] == want)
            assert [row[f"n_{k}"] for k in private.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
            assert [s for s in row["spans"].split(",") if s and not s.startswith("crf_")] == [s for s in listed(base).split(",") if s]
    assert by_id[2_006][0]["n_email"] == 20_000 and by_id[1_000][0]["spans"] == "" == by_id[1_002][0]["spans"]
    nothing = private.op11_private(spark, f"{tmp_path}/none")
    assert nothing.count() == 0 and nothing.columns == list(found[0].asDict())


def test_without_anything_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "no data here"), (2, None)], "doc_id long, text string")
    assert private.train_field(private.label_by_patterns(docs)) is None
    assert [r["spans"] for r in private.find_private(docs, None).collect()] == [[], []]


def test_spans_beside_base_spans():
    base = [(5, 0, 10), (20, 1, 30), (22, 3, 40)]
    assert private.merged(base, [(0, 4, 5), (9, 4, 12), (10, 5, 20), (35, 6, 36), (40, 7, 41)]) == sorted(base + [(0, 4, 5), (10, 5, 20), (40, 7, 41)])
