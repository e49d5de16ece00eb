"""Quality scores by compression: two zstandard dictionaries, of good and of bad text.

A text is cut into blocks of BLOCK bytes, each compressed against both dictionaries, since in a
long frame the text's own history would outweigh the dictionary. The feature is the difference of
the summed sizes over the bytes of the text; a logistic curve fitted on labelled rows that built
neither dictionary, over the whole of each, turns it into a calibrated score. The dictionaries come
from at most MAX_TRAIN labelled rows, of a long one TRAIN_BYTES in blocks spread over the whole text,
and have DICTIONARY_BYTES each; they and the two numbers of the curve are all that is
broadcast. Scoring is one pass over the documents without a shuffle.

Defined results: null and empty texts have the difference 0 and so the curve's value there; a
null doc_id counts as held-in; repeated rows are scored each; without labels of both kinds every
score is the share of good labels (0.5 without labels); an input column of the score's name is
replaced; other extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import cut_lineage, read_table
from feedlake.llm.labelled import id_remainder, training_rows

MAX_TRAIN = 8_000
TRAIN_BYTES = 16_384
DICTIONARY_BYTES = 112_640
BLOCK = 1_024
LEVEL = 1
THRESHOLD = 0.7


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class CompressionClassifier:
    """good, bad: dictionaries; slope, shift: of the logistic curve."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, shift: float = 0.0) -> None:
        self.good, self.bad, self.slope, self.shift = good, bad, slope, shift
        self._open: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _compressors(self):
        if self._open is None:
            self._open = []
            for raw in (self.good, self.bad):
                words = zstandard.ZstdCompressionDict(raw)
                words.precompute_compress(level=LEVEL)
                self._open.append(
                    zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False, write_checksum=False)
                )
        return self._open

    def difference(self, text: str) -> float:
        """How many bytes a byte of text saves with the good dictionary rather than the bad one."""
        data = text.encode("utf-8", "replace")
        if not data or not self.good:
            return 0.0
        good, bad = self._compressors()
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(data)) / len(data)

    def score(self, text: str) -> float:
        x = self.slope * self.difference(text) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge."""
    a, b = 0.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + 1e-4 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-4, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        scale = min(1.0, 50 / (np.abs(d).max() + 1e-12))
        a, b = a - scale * d[0], b - scale * d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


def spread_blocks(text: str) -> list[bytes]:
    """Blocks of the text for a dictionary: all of them, or TRAIN_BYTES of them spread evenly from its start to its end."""
    every, most = blocks(text.encode("utf-8", "replace")), TRAIN_BYTES // BLOCK
    return every if len(every) <= most else [every[i] for i in np.linspace(0, len(every) - 1, most).astype(int)]


def builds_dictionary(doc_id: int) -> bool:
    return zlib.crc32(f"curve {doc_id}".encode()) % 2 == 0


def fit_dictionaries(ids: list[int], samples: list[list[bytes]], labels: np.ndarray) -> CompressionClassifier:
    """Even ids (by hash) build the dictionaries."""
    dictionaries = []
    for kind in (1, 0):
        chosen = [s for s, i, y in zip(samples, ids, labels) if builds_dictionary(i) and y == kind] or [s for s, y in zip(samples, labels) if y == kind]
        own = [b for s in chosen for b in s]
        try:
            dictionaries.append(zstandard.train_dictionary(DICTIONARY_BYTES, own, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too few samples to train on: their text itself serves
            dictionaries.append(b"".join(own)[-DICTIONARY_BYTES:])
    return CompressionClassifier(*dictionaries)


def train_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> CompressionClassifier:
    """Dictionaries from blocks of labelled texts, and a curve over the differences of whole ones (odd ids by hash)."""
    rows = training_rows(docs, labels, "quality", 4, 2, most)

    @F.pandas_udf("array<binary>")
    def spread(texts: pd.Series) -> pd.Series:
        return texts.map(spread_blocks)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = pd.concat([pd.DataFrame(columns=["doc_id", "samples", "label"]), *batches], ignore_index=True).sort_values("doc_id", kind="stable")
        y = read["label"].to_numpy(np.float64)
        if len(y) and y.min() < y.max():
            made = fit_dictionaries(read["doc_id"].tolist(), [list(s) for s in read["samples"]], y)
            yield pd.DataFrame({"good": [made.good], "bad": [made.bad]})

    rows = cut_lineage(rows.select("doc_id", "text", "label"))
    sizes = rows.agg(F.count("*").alias("n"), F.sum("label").alias("positive")).first()
    n, positive = sizes["n"], sizes["positive"] or 0
    if positive in (0, n):
        share = positive / n if n else 0.5
        return CompressionClassifier(b"", b"", 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    # blocks of ``most`` rows at most: one task builds the dictionaries, away from the driver
    built = rows.select("doc_id", spread("text").alias("samples"), "label").coalesce(1).mapInPandas(fit, "good binary, bad binary").first()
    made = CompressionClassifier(bytes(built["good"]), bytes(built["bad"]))
    kinds = rows.select("doc_id", "label").toPandas()  # ids and labels of ``most`` rows at most
    ids, y = kinds["doc_id"].tolist(), kinds["label"].to_numpy()
    odd = np.array([not builds_dictionary(i) for i in ids])
    every = len(set(y[odd])) < 2
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            own = batch[[every or not builds_dictionary(i) for i in batch["doc_id"]]]
            yield pd.DataFrame({"doc_id": own["doc_id"], "x": own["text"].map(model.difference).astype(float), "y": own["label"].astype(float)})

    found = rows.mapInPandas(differences, "doc_id long, x double, y double").toPandas().sort_values(["doc_id", "x"])
    made.slope, made.shift = fit_logistic(found["x"].to_numpy(), found["y"].to_numpy())
    return made


def score_quality(docs: DataFrame, classifier: CompressionClassifier, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the score of the whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in parts:
            yield pd.Series([model.score(t or "") for t in texts])

    return docs.withColumn(out, score(F.coalesce(F.col("text"), F.lit(""))))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, classifier).select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict[str, str] = {}
