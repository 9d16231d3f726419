"""Vector columns and the matrix kernels behind every scoring query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import bind

PACK_SCALE = 127
# Reference vectors (interests, leaves, queries) are configuration. Past this
# many they are data, and scoring goes through the tiled join instead.
MAX_REFERENCE_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Scaled to length one; a vector without length stays as it is."""
    length = norm(a)
    scale = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(a, lambda x: x.cast("double") / scale)


def unit_of_made(a: Column) -> Column:
    """``unit`` of a vector that is costly to make: vector and length are bound, for a lambda makes again, per component, what stands inside it."""
    by = lambda v, length: F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))
    return bind(a, lambda v: bind(norm(v), lambda length: by(v, length)))


def packed(a: Column) -> Column:
    """A unit vector as whole numbers from -127 to 127, rounding half to even."""
    return F.transform(
        a, lambda x: F.greatest(F.lit(-PACK_SCALE), F.least(F.lit(PACK_SCALE), F.rint(x * PACK_SCALE).cast("int")))
    )


@F.arrow_udf(T.StringType())
def packed_text(values: pa.Array) -> pa.Array:
    """Packed numbers as base64 of their bytes."""
    import base64

    out = [None if v is None else base64.b64encode(np.asarray(v, dtype=np.int8).tobytes()).decode() for v in values.to_pylist()]
    return pa.array(out, pa.string())


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two packed vectors; 0 when a length differs or is zero."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (lengths == 0), F.lit(0.0)).otherwise(dot(a, b) / lengths)


def mean_direction(df: DataFrame, keys: list[str], column: str = "embedding", out: str = "centroid") -> DataFrame:
    """Per key the mean vector, re-normalised.

    The mean is a partial aggregate of one buffer per key and map task, so the
    size of a group never reaches one place.
    """
    mean = Summarizer.mean(array_to_vector(F.col(column)))
    return (
        df.where(F.col(column).isNotNull()).groupBy(*keys).agg(vector_to_array(mean).alias("_mean"))
        .select(*keys, unit(F.col("_mean")).alias(out))
    )


def as_matrix(values: pa.Array) -> np.ndarray:
    """Rows of a list array (no nulls) as a dense matrix of doubles."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.zeros((0, 0))
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(values), -1)


def collect_matrix(df: DataFrame, key: str, vector: str, limit: int = MAX_REFERENCE_ROWS):
    """Keys and matrix of a configuration-sized frame, or None when it is larger."""
    rows = df.select(key, vector).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def scores(vector: Column, matrix: np.ndarray) -> Column:
    """Dot products with every row of a configuration-sized matrix, in its order."""
    matrix = np.ascontiguousarray(matrix.T)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def product(values: pa.Array) -> pa.Array:
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        present = np.asarray(values.is_valid())
        width = matrix.shape[1]
        result = as_matrix(values.drop_null()) @ matrix if present.any() else np.zeros((0, width))
        offsets = np.concatenate([[0], np.cumsum(present * width)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(result.ravel()), mask=pa.array(~present)
        )

    return product(vector)


def ranked(score_array: Column, keys: list) -> Column:
    """Scores as (score, position, key) structs, best first, ties in given order."""
    names = F.array(*[F.lit(k) for k in keys])
    structs = F.transform(
        score_array,
        lambda s, i: F.struct((-s).alias("minus"), i.alias("position"), F.get(names, i).alias("key"), s.alias("score")),
    )
    return F.array_sort(structs)
