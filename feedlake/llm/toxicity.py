"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its lower-cased words and of their leading STEMS characters (so that
inflected forms share terms), hashed into BINS bins. The machine adds a weight
for each bin present and, for each pair of bins present, the product of their factors, so that
"insult with group mention" can weigh more than its two words. It is fitted over
at most MAX_TRAIN labelled rows. Spark hashes them and counts each bin by label; bins in fewer
than MIN_ROWS rows are left out and the MAX_FEATURES with the largest chi-square are kept, which
bounds the model that is broadcast and what one task reads to fit it. Scoring is one pass over the documents without a shuffle.

Defined results: null and empty texts score by the bias alone; a null doc_id counts as held-in;
repeated rows are scored each; without labels of both kinds every score is the share of toxic
labels (0 without labels); an input column of the score's name is replaced; other extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import cut_lineage, read_table
from feedlake.llm.labelled import id_remainder, training_rows

BINS = 1 << 20
MAX_TRAIN = 20_000
MIN_ROWS = 3
MAX_FEATURES = 8_192
FACTORS = 8
EPOCHS = 15
THRESHOLD = 0.5
STEMS = (3, 4, 5, 6)
LEAST_CHI = 8.0
POSITIVE_WEIGHT = 3.0
WORD = re.compile(r"\w+")


def word_bins(word: str) -> list[int]:
    terms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BINS - 1) for t in terms]


class Remembered(dict):
    """Word to what ``make`` gives for it; cleared when it gets large."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        self[word] = found = self.make(word)
        return found


def terms_of(text: str, known: Remembered) -> list[int]:
    """The sorted distinct terms of a text."""
    return sorted(set(chain.from_iterable(map(known.__getitem__, set(WORD.findall(text.lower()))))))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Remembered(word_bins)
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": [terms_of(t, known) for t in batch["text"]]})


class FactorizationMachine:
    """chosen: the sorted bins that have weights."""

    def __init__(self, chosen: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.rows = {int(c): i for i, c in enumerate(chosen)}
        self.bias, self.weights, self.factors = bias, weights, factors

    def features(self, word: str) -> list[int]:
        return [self.rows[c] for c in word_bins(word) if c in self.rows]

    def score(self, rows: list[int]) -> float:
        v = self.factors[rows]
        total = v.sum(0)
        x = self.bias + float(self.weights[rows].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, x)))))


def choose_bins(hashed: DataFrame, rows: int, positive: int) -> np.ndarray:
    """The sorted bins with the largest chi-square against the label (ties: the smaller bin)."""
    rate, seen, hits = positive / rows, F.col("seen"), F.col("hits")
    chi = F.pow(hits - seen * F.lit(rate), F.lit(2.0)) / (seen * F.lit(rate * (1 - rate)))
    best = (
        hashed.select("label", F.explode("terms").alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("seen"), F.sum("label").alias("hits"))
        .where((seen >= min(MIN_ROWS, max(1, rows // 100))) & (chi > LEAST_CHI))
        .orderBy(chi.desc(), "bin").limit(MAX_FEATURES).select("bin").collect()
    )
    return np.array(sorted(r["bin"] for r in best), np.int64)


def fit_machine(chosen: np.ndarray, features: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Fits by AdaGrad on the log loss over mini-batches. features: rows of ``chosen``."""
    rng = np.random.default_rng(seed)
    n, rate = len(labels), float(labels.mean())
    sizes = np.array([len(f) for f in features])
    rows = np.concatenate([np.asarray(f, np.int64) for f in features])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    best = chosen
    w = np.zeros(len(best))
    v = rng.normal(0, 0.02, (len(best), FACTORS))
    b = float(np.log(rate / (1 - rate)))
    gw, gv, gb = np.full(len(best), 1e-6), np.full((len(best), FACTORS), 1e-6), 1e-6
    step, shrink = 0.2, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            batch = order[lo : lo + 256]
            size = starts[batch + 1] - starts[batch]
            if not size.sum():
                continue
            where = np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            r, o = rows[where], np.repeat(np.arange(len(batch)), size)
            vr = v[r]
            total = np.zeros((len(batch), FACTORS))
            np.add.at(total, o, vr)
            squares = np.bincount(o, weights=(vr * vr).sum(1), minlength=len(batch))
            x = b + np.bincount(o, weights=w[r], minlength=len(batch)) + 0.5 * ((total * total).sum(1) - squares)
            err = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - labels[batch]
            err = err * np.where(labels[batch] > 0, POSITIVE_WEIGHT, 1.0)
            used, back = np.unique(r, return_inverse=True)
            dw = np.bincount(back, weights=err[o], minlength=len(used)) / len(batch) + shrink * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, back, err[o][:, None] * (total[o] - vr))
            dv = dv / len(batch) + shrink * v[used]
            db = err.mean()
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += db * db
            w[used] -= step * dw / np.sqrt(gw[used])
            v[used] -= 0.25 * step * dv / np.sqrt(gv[used])
            b -= step * db / np.sqrt(gb)
    return FactorizationMachine(chosen, b, w.astype(np.float32), v.astype(np.float32))


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> FactorizationMachine:
    rows = training_rows(docs, labels, "toxic", 5, 0, most)
    hashed = cut_lineage(rows.mapInPandas(_hashed, "doc_id long, label int, terms array<int>"))
    sizes = hashed.agg(F.count("*").alias("n"), F.sum("label").alias("positive")).first()
    n, positive = sizes["n"], sizes["positive"] or 0
    if positive in (0, n):
        return FactorizationMachine(np.zeros(0, np.int64), 30.0 if n and positive else -30.0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    chosen = choose_bins(hashed, n, positive)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = shared.value
        for batch in batches:
            found = [np.searchsorted(bins, np.intersect1d(bins, t)).astype(np.int32) for t in batch["terms"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "features": found})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True).sort_values("doc_id", kind="stable")
        m = fit_machine(shared.value, list(rows["features"]), rows["label"].to_numpy(np.float64))
        yield pd.DataFrame({"bias": m.bias, "weight": m.weights.astype(np.float64), "factors": list(m.factors.astype(np.float64))})

    if not len(chosen):
        rate = positive / n
        return FactorizationMachine(chosen, float(np.log(rate / (1 - rate))), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    read = hashed.mapInPandas(kept, "doc_id long, label int, features array<int>")
    # MAX_TRAIN rows of features at most: one task fits them, away from the driver
    made = read.coalesce(1).mapInPandas(fit, "bias double, weight double, factors array<double>").collect()
    shared.unpersist()
    weights = np.array([r["weight"] for r in made], np.float32)
    return FactorizationMachine(chosen, made[0]["bias"], weights, np.array([r["factors"] for r in made], np.float32))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the score of the whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        known = Remembered(model.features)
        for texts in parts:
            yield pd.Series([model.score(terms_of(t, known)) for t in texts], dtype="float64")

    return docs.withColumn(out, score(F.coalesce(F.col("text"), F.lit(""))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, machine).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
