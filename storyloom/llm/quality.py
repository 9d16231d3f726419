"""Quality by compression: how much better a text packs with a dictionary of good
text than with one of bad text, turned into a probability.

Two Zstandard dictionaries are trained on labelled texts. A text is cut into
blocks of ``BLOCK`` bytes, all of them are packed with either dictionary and with
none, and the size difference over the plain size is the main feature; the sizes
over the length and the packed size of the whole text (repetition inside it)
complete it. A logistic fit on labelled texts that the dictionaries did not see
calibrates the score; a sampled text counts as often as its label has rows for it.

Fitting takes a bounded sample of labelled rows (``max_rows``, ``max_bytes`` per
label); scoring takes every whole text. Null and empty texts score as a text of
no bytes. Repeated rows and ids are scored row by row; without rows of both
labels every score is the share of good labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Logistic, bounded_sample, fold, label_rows, one_label, row_weights, unused

BLOCK, LEVEL, DICTIONARY_BYTES = 2048, 3, 1 << 16
MAX_ROWS, MAX_BYTES = 6000, 48_000_000
THRESHOLD = 0.7


def _blocks(data: bytes) -> list[bytes]:
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Features:
    """Compressed sizes of a text under the dictionaries, per text a vector."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.plain = self._packer(good), self._packer(bad), self._packer(b"")

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) < 8:
            return zstandard.ZstdCompressor(**plain)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, **plain)

    def __call__(self, text: str | None) -> list[float]:
        data = (text or "").encode("utf-8", "replace")
        n, parts = max(1, len(data)), _blocks(data)
        good = sum(len(self.good.compress(b)) for b in parts)
        bad = sum(len(self.bad.compress(b)) for b in parts)
        plain = sum(len(self.plain.compress(b)) for b in parts)
        whole = len(self.plain.compress(data)) if len(parts) > 1 else plain
        return [(bad - good) / plain, good / n, bad / n, whole / n, plain / n, math.log(n), (plain - whole) / n]


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibrate: Logistic | None
    prior: float

    def score(self, texts) -> np.ndarray:
        if self.calibrate is None or not len(texts):
            return np.full(len(texts), self.prior)
        features = Features(self.good, self.bad)
        return self.calibrate(np.array([features(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """``labels`` (doc_id, label): every second sampled text trains the dictionaries, the others calibrate."""
    rows = bounded_sample(docs, labels, max_rows, max_bytes)
    totals = label_rows(docs, labels)
    prior = totals[1] / sum(totals.values()) if any(totals.values()) else 0.5
    halves = {label: [t for t, y in rows if y == label] for label in (0, 1)}
    if min(map(len, halves.values())) < 2:
        return Model(b"", b"", None, prior)
    good, bad = (_dictionary([b for t in halves[label][::2] for b in _blocks(t.encode())]) for label in (1, 0))
    features = Features(good, bad)
    held = [(features(t), y) for y, texts in halves.items() for t in texts[1::2]]
    weights = row_weights(rows, totals)
    fitted = Logistic(np.array([x for x, _ in held]), np.array([y for _, y in held]), np.array([weights[y] for _, y in held]))
    return Model(good, bad, fitted, prior)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1; all columns stay, one of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts))

    return docs.withColumn(out, rate(F.col("text")))


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) outside the held-out fold."""
    return one_label(labels, "quality").where(fold(F.col("doc_id"), 4) != 2)


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, learning_labels(labels)))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored ``THRESHOLD`` or more, columns and their values as they came."""
    columns = docs.columns
    out = unused(columns, "quality")
    return score(docs, fit(docs, learning_labels(labels)), out).where(F.col(out) >= THRESHOLD).select(*columns)
