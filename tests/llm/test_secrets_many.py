"""Texts of very many matches, repeated rows and hot values in the secret scan."""

import random
import re

from pyspark.sql import functions as F

from feedlake.llm import common, secrets


def test_places_in_a_text_of_many_matches(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["é", " token=abcdef%d" % k, " %026x " % rng.getrandbits(104), "AKIA" + "Q" * rng.randrange(30)]) for k in range(4_000))
    df = spark.createDataFrame([(text,)], "text string")
    for no, (kind, pattern, group, least) in enumerate(secrets.BASE):
        got = [(r["start"], r["end"]) for r in df.select(F.inline(secrets.spans_of(F.col("text"), kind, no, pattern, group, least))).collect()]
        want = [m.span() for m in re.finditer(pattern.replace("(?i)", ""), text, re.I | re.A if kind == "assign" else 0) if len(m[group]) >= least]
        assert got == want and len(want) > 300


def test_running_sums(spark):
    for n in (0, 1, 511, 512, 513, 1_200):
        values = [(k * 7) % 11 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<bigint>")
        want = [sum(values[: k + 1]) for k in range(n)]
        assert df.select(secrets.running_sums(F.col("v"))).first()[0] == want


def test_repeated_rows_and_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "token = Qw3rTy7UiOp9AsDf2", f"o{i % 3}") for i in range(20)] + [(1, "token = Qw3rTy7UiOp9AsDf2", "o1")] * 2 + [(90, "password = Zz9Yy8Xx7Ww6Vv5Uu4", "o9"), (91, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secrets.scan_secrets(df).collect()
    assert len(out) == len(rows) and sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    verdicts = {r["doc_id"]: [(s["verdict"], s["owners"], s["repositories"]) for s in r["secrets"]] for r in out}
    assert verdicts[1] == [("copied", 3, 20)] and verdicts[90] == [("live", 1, 1)] and verdicts[91] == []


def test_many_base_spans_and_live_bare_tokens(spark):
    """A text of very many credentials, once assigned and once bare, takes no time for each pair of them."""
    import time

    rng = random.Random(4)
    values = ["".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(20)) + "7x" for _ in range(8_000)]
    text = " ".join(f"token={v}" for v in values) + " " + " ".join(values)
    rows = [(1, text, "a"), (2, "token=" + values[0] + " then " + values[0] + "=" + values[1], "a")]
    began = time.time()
    found = {r["doc_id"]: r["secrets"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert time.time() - began < 200
    kinds = [s["kind"] for s in found[1]]
    assert kinds.count("assign") == 8_000 and kinds.count("reuse") == 8_000
    base = [(s["start"], s["end"]) for s in found[1] if s["kind"] != "reuse"]
    assert all(s["start"] >= base[-1][1] for s in found[1] if s["kind"] == "reuse")
    assert [s["kind"] for s in found[2]] == ["assign"] and [(s["start"], s["end"]) for s in found[1]] == sorted((s["start"], s["end"]) for s in found[1])


def test_bare_tokens_around_base_spans(spark):
    """Overlap by definition, on texts where base spans begin before, inside and after bare tokens."""
    live = "Qw3rTy7UiOp9AsDf2"
    texts = [f"token={live}", f"{live} x", f"x={live} token={live}", f"{live}token={live}", f"token={live}.{live}", f"secret: {live} {live}", f"a{'0123456789abcdef' * 2} {live}"]
    docs = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secrets.scan_secrets(docs).collect():
        base = [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] != "reuse"]
        found = [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == "reuse"]
        bare = [m.span() for m in re.finditer(secrets.BARE, texts[r["doc_id"]]) if m[0] == live]
        assert found == [b for b in bare if not any(s < b[1] and b[0] < e for s, e in base)]
