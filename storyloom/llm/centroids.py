"""Exact k-means over integer vectors, filtered by rotated leading coordinates.

Components become integers. A rotation by the principal axes (from the moments of
all vectors) is stored beside each vector as its ``LEAD`` leading coordinates and
the length of the rest. For a vector v and a centroid c

    |lead(v) - lead(c)|^2 + (rest(v) - rest(c))^2 <= |v - c|^2,

so a centroid whose bound exceeds a distance already known cannot be nearest.
Only what survives is measured, in integers; the bound only saves work.

Centroids (at most ``k`` rows) and sums (``k * dims`` numbers) are all that
reaches the driver or is broadcast; each task adds up its own vectors first, so
no key is ever hot. A round reads the stored table again and shuffles sums alone.

Vectors of another length than ``dims``, null or holding a null or non-finite
component are left out; components beyond ``LARGEST`` as integers are refused with
an error, for distances must fit 64 bits. Repeated rows and ids each count; of rows of
one id the smaller vector starts first, null ids last. With fewer vectors than ``k``
there are as many centroids as vectors; without any the result is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import drop, stored

LEAD = 16
LARGEST = 1 << 27


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component, in doubles; an error where distances could overflow."""
    def floored(x):
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, value).otherwise(F.raise_error(F.lit("vector component too large")).cast("long")).cast("int")

    return F.transform(vector, floored)


def usable(vector: Column, dims: int) -> Column:
    """Whether the vector has ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of integer lists of one length as int64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def axes(vectors: DataFrame, dims: int, lead: int) -> np.ndarray:
    """The ``lead`` principal axes (columns) of ``x`` over all vectors: tasks return their moments, the driver turns one small matrix."""

    def moments(batches):
        total, n = np.zeros((dims + 1, dims)), 0
        for batch in batches:
            x = matrix(batch.column("x"), dims).astype(float)
            total += np.vstack([x.T @ x, x.sum(0)])
            n += len(x)
        if n:
            flat = np.append(total.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])

    cells = vectors.select("x").mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.array([r.value for r in sorted(cells)])
    total, n = flat[:-1].reshape(dims + 1, dims), flat[-1]
    mean = total[dims] / n
    values, found = np.linalg.eigh(total[:dims] / n - np.outer(mean, mean))
    return found[:, np.argsort(-values, kind="stable")[:lead]]


def rotate(vectors: DataFrame, dims: int, turn: np.ndarray) -> DataFrame:
    """``vectors`` with ``lead`` and ``rest``, in single precision."""

    def turned(batches):
        for batch in batches:
            lead, rest = split(matrix(batch.column("x"), dims), turn)
            at = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * turn.shape[1])
            lists = pa.ListArray.from_arrays(at, pa.array(lead.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(rest.astype(np.float32))], [*batch.schema.names, "lead", "rest"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(turned, f"{fields}, lead array<float>, rest float")


def split(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the length of what they leave."""
    x = x.astype(float)
    lead = x @ turn
    return lead, np.sqrt(np.maximum((x * x).sum(1) - (lead * lead).sum(1), 0))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centre (ties: the smaller), squared distance, and how many distances were measured."""
    far, own = split(centres, turn)
    lead, rest = lead.astype(float), rest.astype(float)
    bound = (lead * lead).sum(1)[:, None] - 2 * lead @ far.T + (far * far).sum(1) + (rest[:, None] - own) ** 2
    # Single precision moves a coordinate by at most 6e-8 of the vector's length.
    length = np.sqrt((lead * lead).sum(1) + rest * rest)[:, None] + np.sqrt((far * far).sum(1) + own * own)
    bound -= 1e-6 * length * length + 1e-6
    first = bound.argmin(1)
    known = ((x - centres[first]) ** 2).sum(1)
    rows, which = np.nonzero(bound <= known[:, None])
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[np.arange(len(x)), first] = known
    more = which != first[rows]
    rows, which = rows[more], which[more]
    distance[rows, which] = ((x[rows] - centres[which]) ** 2).sum(1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best], len(x) + len(rows)


def _parts(batch: pa.RecordBatch, dims: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    turned = batch.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, lead)
    return matrix(batch.column("x"), dims), turned, batch.column("rest").to_numpy(zero_copy_only=False)


def sums(table: DataFrame, centres: np.ndarray, turn: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centre that has vectors their number and componentwise sum."""
    k, dims = centres.shape

    def add(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x, lead, rest = _parts(batch, dims, turn.shape[1])
            best, _, _ = nearest(x, lead, rest, centres, turn)
            for c in np.unique(best):
                own = x[best == c]
                total[c] += np.append(own.sum(0), len(own))
        cluster, place = np.divmod(np.arange(total.size), dims + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total.ravel())], ["cluster", "place", "total"])

    rows = table.select("x", "lead", "rest").mapInArrow(add, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    by = {(r.cluster, r.place): r.total for r in rows}
    return {c: (by[c, dims], [by[c, j] for j in range(dims)]) for c in range(k) if by.get((c, dims))}


def cluster(vectors: DataFrame, starts: Column, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable vector, final centres).

    ``starts`` orders the rows by ``vec_id``: the ``k`` first are the centres to begin with.
    """
    kept = vectors.where(usable(F.col("embedding"), dims)).select("vec_id", whole_numbers(F.col("embedding"), scale).alias("x"))
    first = kept.orderBy(starts.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, dims), np.int64)
    centres = np.array([r.x for r in first], np.int64)
    turn = axes(kept, dims, min(lead, dims))
    table = stored(rotate(kept, dims, turn), "rotated")
    for _ in range(rounds):
        moved = centres.copy()
        for c, (n, total) in sums(table, centres, turn).items():
            moved[c] = [t // n for t in total]
        if (moved == centres).all():
            break  # every further round would repeat this one
        centres = moved

    def label(batches):
        for batch in batches:
            x, own, rest = _parts(batch, dims, turn.shape[1])
            best, distance, _ = nearest(x, own, rest, centres, turn)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    fields = f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    labelled = stored(table.mapInArrow(label, fields), "clusters")
    drop(table)
    return labelled, centres


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; 8 centres, 10 rounds."""
    starts = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    labelled, centres = cluster(vectors, starts)
    spent = {r.cluster: r.spent for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("spent")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    ends = [(c, spent[c], sum(spent.values()), names[c]) for c in sorted(spent)]  # a row per centre
    ends = labelled.sparkSession.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
