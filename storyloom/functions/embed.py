"""Turning text into unit vectors with any embedder, in batches on the workers."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.items import embedding_text

BATCH = 64
Embedder = Callable[[Sequence[str]], np.ndarray]


def hashed_terms(dimension: int = 64) -> Embedder:
    """The default embedder: term counts by hashed position.

    It stands where a model would be given; near copies of a text get near
    vectors, which is what the jobs after it need.
    """
    term = re.compile(r"[^\W_]+")
    places: dict[str, int] = {}

    def embed(texts: Sequence[str]) -> np.ndarray:
        if len(places) > 1_000_000:
            places.clear()
        out = np.zeros((len(texts), dimension))
        for row, text in enumerate(texts):
            for word, times in Counter(term.findall(text.lower())).items():
                place = places.get(word)
                if place is None:
                    place = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension
                out[row, place] += times
        return out

    return embed


def embedded(text: Column, embedder: Embedder) -> Column:
    """``array<float>`` of length one, or zeros where a text gives nothing."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(values: pa.Array) -> pa.Array:
        texts = [v or "" for v in values.to_pylist()]
        out = []
        for start in range(0, len(texts), BATCH):
            m = np.asarray(embedder(texts[start:start + BATCH]), dtype=np.float64)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            out.extend((m / np.where(length == 0, 1.0, length)).astype(np.float32))
        return pa.array(out, pa.list_(pa.float32()))

    return run(text)


def single_model(vectors: DataFrame) -> DataFrame:
    """(dimension, vectors); more than one row means vectors that do not compare."""
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("vectors"))


def check_model(vectors: DataFrame, name: str) -> None:
    """Refuses ``vectors`` (with ``model``, the name each was made with) of any other model than ``name``: they do not compare, whatever their dimension."""
    other = vectors.where(~F.col("model").eqNullSafe(F.lit(name))).select("model").first()
    if other is not None:
        raise ValueError(f"vectors were made with {other['model']!r}, not {name!r}: embed everything again to switch")


def pending(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items without a vector, or with one of other content than theirs is now."""
    held = vectors.select("item_id", F.col("content_hash").alias("embedded_hash"))
    return items.join(held, "item_id", "left").where(~F.col("embedded_hash").eqNullSafe(F.col("content_hash"))).drop("embedded_hash")


def embed_pending(items: DataFrame, vectors: DataFrame, name: str, embedder: Embedder) -> DataFrame:
    """``vectors`` (item_id, content_hash, model, embedding) after every pending item is embedded by the model ``name``.

    Vectors of items that are gone stay; vectors of another model are refused.
    """
    check_model(vectors, name)
    todo = pending(items, vectors)
    made = todo.select("item_id", "content_hash", F.lit(name).alias("model"), embedded(embedding_text(), embedder).alias("embedding"))
    return vectors.select(*made.columns).join(todo.select("item_id"), "item_id", "left_anti").unionByName(made)
