"""Vector codes by Lloyd rounds whose members stay where they are.

A vector is cut into parts; each position has a codebook. A part is a member of
its nearest entry and lies in the rows of one owner, (position, entry, salt). A
round: owners add up their resident members, the new entries come of the sums;
owners hold the members against them; members whose entry stays are kept in place,
and only the others are shuffled to their new owners. What lies where is a written
table, a *generation*: files of those that stayed, written by the tasks that read
them, and files of those that arrived. A lost executor repeats its part of a round.

The salt deals a large entry to many owners, so one entry, or copies of one vector,
never meet in one task. Sums are taken by owner first; the driver and the tasks
hold codebooks only (``parts * entries`` rows).

Vectors of another length than ``dims``, null or holding a null or non-finite
component are left out; components beyond the range of ``whole_numbers`` are
refused. Repeated rows and ids each count; of rows of one id the smaller vector
starts first, null ids last. With fewer vectors than entries the codebook is as
short; without any the result is empty. Columns other than ``vec_id``,
``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.centroids import matrix, usable, whole_numbers
from storyloom.llm.common import drop, stored
from storyloom.session import scratch

#: Salts per (position, entry), and members an owner holds at most when one entry has all: more rows, more salts.
SALTS, OWNER_ROWS = 32, 1 << 18


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and squared distance, exact."""
    # |x|^2 - 2 x.e + |e|^2 in integers: no matrix of differences.
    distance = (part * part).sum(1)[:, None] - 2 * (part @ entries.T) + (entries * entries).sum(1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(part)), best]


def _members(position, entry, salt, part: np.ndarray, moved=None) -> pa.RecordBatch:
    at = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
    columns = {"position": np.asarray(position, np.int32), "entry": np.asarray(entry, np.int32), "salt": np.asarray(salt, np.int32)}
    arrays = [*map(pa.array, columns.values()), pa.ListArray.from_arrays(at, pa.array(part.astype(np.int32).ravel()))]
    names = [*columns, "part"]
    if moved is not None:
        arrays, names = [*arrays, pa.array(moved)], [*names, "moved"]
    return pa.RecordBatch.from_arrays(arrays, names)


_MEMBER = "position int, entry int, salt int, part array<int>"


def _enter(kept: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """Every part as a member of its nearest entry; salts by row number, so that copies are dealt apart."""
    parts, _, width = books.shape

    def cut(batches):
        for batch in batches:
            x = matrix(batch.column("x"), parts * width)
            salt = batch.column("row").to_numpy() % salts
            for p in range(parts):
                part = x[:, p * width:(p + 1) * width]
                yield _members(np.full(len(x), p), nearest(part, books[p])[0], salt, part)

    return kept.select("x", F.monotonically_increasing_id().alias("row")).mapInArrow(cut, _MEMBER)


def _hold(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Residents against the new entries: ``moved`` are those of another entry now."""
    width = books.shape[2]

    def assign(batches):
        for batch in batches:
            part, position, old = matrix(batch.column("part"), width), batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            entry = old.copy()
            for p in np.unique(position):
                own = position == p
                entry[own] = nearest(part[own], books[p])[0]
            yield _members(position, entry, batch.column("salt").to_numpy(), part, entry != old)

    return members.mapInArrow(assign, f"{_MEMBER}, moved boolean")


def _to_owners(members: DataFrame, owners: int) -> DataFrame:
    return members.repartition(owners, "position", "entry", "salt")


def _update(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of its resident members' mean; an entry without members stays."""
    width = books.shape[2]
    total = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *[F.sum(F.get("part", F.lit(j))).alias(f"s{j}") for j in range(width)])
    moved = books.copy()
    for r in total.collect():
        moved[r.position, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return moved


def codebooks(kept: DataFrame, parts: int, entries: int, rounds: int, dims: int, owner_rows: int = OWNER_ROWS) -> np.ndarray:
    """(parts, entries, dims / parts) integers after ``rounds`` rounds over (vec_id, x)."""
    spark = kept.sparkSession
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    rows = kept.count()
    salts = max(SALTS, -(-rows // owner_rows))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts * -(-rows // owner_rows))
    members, older = stored(_to_owners(_enter(kept, books, salts), owners), "members"), []
    for done in range(1, rounds + 1):
        books, old = _update(members, books), books
        if done == rounds or (books == old).all():
            break  # nothing would move any more
        folder = scratch(spark, "members")
        _hold(members, books).write.partitionBy("moved").parquet(folder)
        held = spark.read.schema(f"{_MEMBER}, moved boolean").parquet(folder)
        stayed, went = held.where("NOT moved").drop("moved"), held.where("moved").drop("moved")
        arrived = stored(_to_owners(went, owners), "arrived")
        drop(*older)
        members, older = stayed.unionByName(arrived), [held, arrived]
    drop(*older)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``code`` and ``error`` of every row of (vec_id, label, x), which pass through."""
    parts, _, width = books.shape

    def code(batches):
        for batch in batches:
            x = matrix(batch.column("x"), parts * width)
            found = [nearest(x[:, p * width:(p + 1) * width], books[p]) for p in range(parts)]
            digits = np.stack([best for best, _ in found], 1).astype(np.uint8) if len(x) else np.zeros((0, parts), np.uint8)
            texts = [row.tobytes().hex() for row in digits]
            error = sum((d for _, d in found), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select("vec_id", "label").schema.fields)
    return kept.select("vec_id", "label", "x").mapInArrow(code, f"{fields}, code string, error long")


def report(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, dims: int = 64, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector; entries are at most 256."""
    kept = vectors.where(usable(F.col("embedding"), dims)).select("vec_id", "label", whole_numbers(F.col("embedding"), scale).alias("x"))
    if kept.isEmpty():
        empty = "'' AS code, 0L AS error, 0L AS label_error, '' AS codebooks_sha256"
        return kept.selectExpr("vec_id", *empty.split(", ")).limit(0)
    books = codebooks(kept, parts, entries, rounds, dims)
    coded = stored(encode(kept, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
