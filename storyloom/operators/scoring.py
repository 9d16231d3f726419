"""The best reference vectors of every row, whatever the number of references.

Up to ``MOST_BROADCAST`` references are one matrix on every worker: rows are scored
where they lie and nothing is shuffled. More of them meet the rows in tiles, a block
of rows against a block of references; a tile returns the best ``n`` of its block
per row, and the blocks' lists are merged. Neither way keeps a row's other scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.functions import vectors as V

#: 2 MB of 64 doubles.
MOST_BROADCAST = 4096
BLOCK_ROWS = 2048


def best_places(scores: np.ndarray, n: int | None) -> np.ndarray:
    """Per row the columns of the ``n`` greatest scores (None: all), greatest first; equal ones in column order."""
    n = scores.shape[1] if n is None else min(n, scores.shape[1])
    if n > 8:
        return np.argsort(-scores, axis=1, kind="stable")[:, :n]
    left, rows = scores.copy(), np.arange(len(scores))
    places = np.empty((len(scores), n), np.int64)
    for k in range(n):
        places[:, k] = left.argmax(1)
        left[rows, places[:, k]] = -np.inf
    return places


def _lists(scores: np.ndarray, keys: pa.Array, n: int | None) -> pa.ListArray:
    """The best of each row as lists of (key, score)."""
    places = best_places(scores, n)
    flat = pa.StructArray.from_arrays(
        [keys.take(pa.array(places.ravel())), pa.array(np.take_along_axis(scores, places, 1).ravel())], ["key", "score"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * places.shape[1]), flat)


def with_best(rows: DataFrame, key: str, vector: str, references: DataFrame, n: int | None, out: str, most: int = MOST_BROADCAST) -> DataFrame:
    """``rows`` with ``out``, the best ``n`` of ``references`` (key, vector) as (key, score), best first, ties by key.

    ``key`` names a row; a row without a vector, or without references, gets an empty list.
    """
    found = V.collect_matrix(references, "key", "vector", most)
    kind = references.schema["key"].dataType
    result = T.ArrayType(T.StructType([T.StructField("key", kind), T.StructField("score", T.DoubleType())]))
    none = F.array().cast(result)
    if found is None:
        merged = best_in_tiles(rows.select(F.col(key).alias("_row"), F.col(vector).alias("_vector")), references, n).withColumnRenamed("best", out)
        return rows.join(merged, F.col(key) == F.col("_row"), "left").drop("_row").withColumn(out, F.coalesce(out, none))
    names, matrix = found
    if not names:
        return rows.withColumn(out, none)
    names, matrix = pa.array(names, to_arrow_type(kind)), np.ascontiguousarray(matrix.T)

    @F.arrow_udf(result)
    def score(values: pa.Array) -> pa.Array:
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        return _lists(V.as_matrix(values) @ matrix if len(values) else np.zeros((0, matrix.shape[1])), names, n)

    # Rows without a vector are scored as nought and emptied again: the matrix needs a number everywhere.
    nought = F.array_repeat(F.lit(0.0), matrix.shape[0])
    scored = rows.withColumn(out, score(F.coalesce(F.col(vector).cast("array<double>"), nought)))
    return scored.withColumn(out, F.when(F.col(vector).isNull(), none).otherwise(F.col(out)))


def best_in_tiles(rows: DataFrame, references: DataFrame, n: int | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_row, best) of ``rows`` (_row, _vector) by block against block."""
    rows = rows.where("_vector IS NOT NULL")
    row_type, kind = rows.schema["_row"].dataType, references.schema["key"].dataType
    pair = T.StructType([T.StructField("key", kind), T.StructField("score", T.DoubleType())])
    result = T.StructType([T.StructField("_row", row_type), T.StructField("best", T.ArrayType(pair))])

    def meet(tile: pa.Table) -> pa.Table:
        is_reference = tile.column("is_reference")
        held, asked = tile.filter(pc.invert(is_reference)), tile.filter(is_reference).sort_by("key")
        if not held.num_rows or not asked.num_rows:
            return pa.table({"_row": pa.array([], to_arrow_type(row_type)), "best": pa.array([], to_arrow_type(result["best"].dataType))})
        scores = V.as_matrix(held.column("_vector")) @ V.as_matrix(asked.column("_vector")).T
        return pa.table({"_row": held.column("_row"), "best": _lists(scores, asked.column("key").combine_chunks(), n)})

    blocks = lambda df: max(1, -(-df.count() // block_rows))
    n_rows, n_references = blocks(rows), blocks(references)
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    own = lambda name, column, count: F.pmod(F.xxhash64(column), F.lit(count)).cast("int").alias(name)
    left = rows.select("_row", F.lit(None).cast(kind).alias("key"), F.col("_vector").cast("array<double>").alias("_vector"), F.lit(False).alias("is_reference"),
                       own("rb", "_row", n_rows), every("fb", n_references))
    right = references.select(F.lit(None).cast(row_type).alias("_row"), "key", F.col("vector").cast("array<double>").alias("_vector"), F.lit(True).alias("is_reference"),
                              every("rb", n_rows), own("fb", "key", n_references))
    parts = left.unionByName(right).groupBy("rb", "fb").applyInArrow(meet, result)
    # A row has a list per block of references, each at most n long.
    order = F.transform(F.flatten(F.collect_list("best")), lambda b: F.struct((-b["score"]).alias("minus"), b["key"].alias("key"), b["score"].alias("score")))
    merged = F.array_sort(order)
    merged = F.transform(merged if n is None else F.slice(merged, 1, n), lambda b: F.struct(b["key"].alias("key"), b["score"].alias("score")))
    return parts.groupBy("_row").agg(merged.alias("best"))
