"""Packing documents into sequences as a cutting-stock problem.

A document is its token ids and the end id. Every full run of ``SEQUENCE`` ids is
a sequence of its own; what is left, the tail, is an item. Tails are counted in
length classes of ``UNIT`` ids, so the linear program over cutting patterns has at
most ``SEQUENCE / UNIT`` rows whatever the corpus holds. Columns are priced by a
knapsack over the duals until none improves; the fractions are rounded down and
the patterns are dealt to the tails by their rank in the class. A rank is a
position inside one written partition plus the count of the class in the
partitions before, so no class has to meet in one task.

Rounding leaves fewer tails than there are patterns times items in a pattern,
a number the classes bound. They are laid end to end and cut at sequence ends;
the last stretch is cut into powers of two, which need no padding.

Null text is an empty document: its end id alone. Equal rows are documents of
their own. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import stored
from storyloom.llm.tokens import tokens

SEQUENCE, UNIT, END_ID = 4096, 8, 2
BINS = SEQUENCE // UNIT
#: Texts encoded together.
TEXTS = 64
#: The linear program is solved to within this share of its optimum.
GAP = 5e-4


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: counts of each size within ``room`` of the greatest value."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for cap in range(1, room + 1):
        k = fitting[cap]
        best[cap] = best[cap - 1]
        if k:
            gain = best[cap - sizes[:k]] + values[:k]
            at = int(gain.argmax())
            if gain[at] > best[cap] + 1e-12:
                best[cap], choice[cap] = gain[at], at
    counts, cap = np.zeros(len(sizes), np.int64), room
    while cap > 0:
        if choice[cap] < 0:
            cap -= 1
            continue
        counts[choice[cap]] += 1
        cap -= sizes[choice[cap]]
    return float(best[room]), counts


def patterns(demand: np.ndarray, room: int = BINS) -> list[tuple[int, np.ndarray]]:
    """(times, count of each class) for ``demand[c]`` items of size ``c``: rounded column generation."""
    sizes = np.flatnonzero(demand[:room + 1])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return []
    wanted = demand[sizes].astype(float)
    # The first basis cuts one size per pattern; the columns of the basis are the patterns.
    basis = np.diag((room // sizes).astype(float))
    inverse, amounts = np.diag(1.0 / basis.diagonal()), wanted / basis.diagonal()
    for step in range(40 * len(sizes)):
        value, column = best_pattern(inverse.sum(0), sizes, room)
        # The optimum is at least the present total divided by the best column's value.
        if value <= 1 + GAP:
            break
        along = inverse @ column
        out = np.where(along > 1e-10, amounts / np.maximum(along, 1e-10), np.inf)
        row = int(out.argmin())
        if not np.isfinite(out[row]):
            break
        move = out[row]
        amounts = np.maximum(amounts - move * along, 0.0)
        amounts[row] = move
        inverse[row] /= along[row]
        others = np.arange(len(sizes)) != row
        inverse[others] -= np.outer(along[others], inverse[row])
        basis[:, row] = column
        if step % 200 == 199:  # fresh inverse against rounding errors
            inverse = np.linalg.inv(basis)
            amounts = np.maximum(inverse @ wanted, 0.0)
    left, chosen = demand[sizes].astype(np.int64), []
    for at in np.argsort(-amounts, kind="stable"):
        used = basis[:, at].round().astype(np.int64)
        need = used > 0
        times = int(min(np.floor(amounts[at] + 1e-6), (left[need] // used[need]).min()))
        if times > 0:
            left -= times * used
            full = np.zeros(room + 1, np.int64)
            full[sizes] = used
            chosen.append((times, full))
    return chosen


def _measured(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: its ids in number, the CRC-32 of every full run and of the tail,
    the partition, and its place among the partition's tails of one class and full runs."""
    schema = "doc_id long, text_key long, doc_tokens long, full_crcs array<long>, tail_crc long, class int, part int, place long, full_place long"
    names = [field.split()[0] for field in schema.split(", ")]

    def measure(batches):
        codec, seen, full = tokens(vocabulary), np.zeros(BINS + 1, np.int64), 0
        for batch in batches:
            counts, crcs, tail_crcs, sizes, places, full_places = [], [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for found in (ids for k in range(0, len(texts), TEXTS) for ids in codec.many(texts[k:k + TEXTS])):
                ids = np.append(found, np.uint32(END_ID)).astype("<u4")
                cut = len(ids) // SEQUENCE
                size = -(-(len(ids) - cut * SEQUENCE) // UNIT)
                counts.append(len(ids))
                crcs.append([zlib.crc32(ids[k * SEQUENCE:(k + 1) * SEQUENCE].tobytes()) for k in range(cut)])
                tail_crcs.append(zlib.crc32(ids[cut * SEQUENCE:].tobytes()))
                sizes.append(size)
                places.append(int(seen[size]))
                full_places.append(full)
                seen[size] += 1
                full += cut
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                pa.array(tail_crcs, pa.int64()), pa.array(sizes, pa.int32()), batch.column("part"), pa.array(places, pa.int64()), pa.array(full_places, pa.int64()),
            ], names)

    own = _keyed(docs).withColumn("part", F.spark_partition_id())
    return own.mapInArrow(measure, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _dealt(ranked: DataFrame, plan: list[tuple[int, np.ndarray]], first_sequence: int) -> DataFrame:
    """``ranked`` (…, class, rank) with the sequence and slot of each tail; null where no pattern takes it.

    The plan's table is as long as the patterns' items: bounded by the classes.
    """
    rows, used, base = [], np.zeros(BINS + 1, np.int64), first_sequence
    for times, counts in plan:
        slot = 0
        for size in np.flatnonzero(counts):
            rows.append((int(size), int(used[size]), int(counts[size]), base, slot))
            used[size] += times * counts[size]
            slot += int(counts[size])
        base += times
    by_class: dict[int, tuple] = {}
    for size in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == size]
        by_class[size] = (int(used[size]), *(np.array([r[k] for r in own]) for k in (1, 2, 3, 4)))
    held = ranked.sparkSession.sparkContext.broadcast(by_class)

    @F.pandas_udf("struct<sequence_id:long,slot:long>")
    def deal(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, slots = np.full(len(sizes), -1), np.full(len(sizes), -1)
        size_of, rank_of = sizes.to_numpy(), ranks.to_numpy()
        for size in np.unique(size_of):
            if size not in held.value:
                continue
            end, starts, per, bases, first = held.value[size]
            at = np.flatnonzero((size_of == size) & (rank_of < end))
            which = np.searchsorted(starts, rank_of[at], side="right") - 1
            inside = rank_of[at] - starts[which]
            sequence[at] = bases[which] + inside // per[which]
            slots[at] = first[which] + inside % per[which]
        return pd.DataFrame({"sequence_id": sequence, "slot": slots})

    return ranked.withColumn("_to", deal("class", "rank")).select(*ranked.columns, "_to.sequence_id", "_to.slot")


def _laid_out(left: list, first_sequence: int) -> list[tuple]:
    """(doc_id, text_key, start, length, doc_tokens, sequence_id, offset) for tails laid end to end."""
    total = sum(r.length for r in left)
    bounds = list(range(SEQUENCE, total + 1, SEQUENCE))
    rest = total % SEQUENCE
    for k in range(12, -1, -1):
        if rest >> k & 1:
            bounds.append((bounds[-1] if bounds else 0) + (1 << k))
    pieces, at, sequence, begin = [], 0, 0, 0
    for r in left:
        start, todo = r.start, r.length
        while todo:
            size = min(todo, bounds[sequence] - at)
            pieces.append((r.doc_id, r.text_key, start, size, r.doc_tokens, first_sequence + sequence, at - begin))
            start, todo, at = start + size, todo - size, at + size
            if at == bounds[sequence]:
                begin, sequence = at, sequence + 1
    return pieces


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    measured = stored(_measured(docs, vocabulary), "pack-measured")
    # Class 0 counts the full runs, so that they too get numbers of their own.
    counts = stored(
        measured.select("part", "class", F.lit(1).alias("n")).where("class > 0")
        .unionByName(measured.select("part", F.lit(0).alias("class"), F.size("full_crcs").alias("n")))
        .groupBy("part", "class").agg(F.sum("n").alias("n")), "pack-counts",
    )
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    demand = np.zeros(BINS + 1, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        demand[r["class"]] = r.n
    n_full, demand[0] = int(demand[0]), 0
    plan = patterns(demand)
    fitted = sum(times for times, _ in plan)

    full = measured.where(F.size("full_crcs") > 0).join(offsets.where("class = 0").select("part", "before"), "part")
    full = full.select("doc_id", "doc_tokens", (F.col("before") + F.col("full_place")).alias("_at"), F.posexplode("full_crcs").alias("_k", "ids_crc32")).select(
        "doc_id", (F.col("_k").cast("long") * SEQUENCE).alias("start"), F.lit(SEQUENCE).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("_at") + F.col("_k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    start = F.col("doc_tokens") - F.col("doc_tokens") % SEQUENCE
    ranked = measured.where("class > 0").join(offsets.where("class > 0").select("part", "class", "before"), ["part", "class"]).select(
        "doc_id", "text_key", start.alias("start"), (F.col("doc_tokens") % SEQUENCE).alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens",
        "class", (F.col("before") + F.col("place")).alias("rank"),
    )
    dealt = stored(_dealt(ranked, plan, n_full), "pack-dealt")
    prior = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    tails = dealt.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(prior), F.lit(0)))
    result = full.unionByName(tails.select(*full.columns))

    # What rounding left over: bounded by the number of classes, never by the documents.
    left = dealt.where("sequence_id < 0").select("doc_id", "text_key", "start", "length", "doc_tokens", "ids_crc32", "class", "rank").collect()
    if not left:
        return result
    left.sort(key=lambda r: (-r["class"], r["rank"]))
    whole = {(r.doc_id, r.text_key, r.start, r.length): r.ids_crc32 for r in left}
    pieces = _laid_out(left, n_full + fitted)
    kept = [(p[0], p[2], p[3], whole[p[:4]], *p[4:]) for p in pieces if p[:4] in whole]
    cut = [p for p in pieces if p[:4] not in whole]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    result = result.unionByName(spark.createDataFrame(kept, schema)) if kept else result
    if cut:
        result = result.unionByName(_recut(docs, cut, vocabulary))
    return result


def _recut(docs: DataFrame, cut: list[tuple], vocabulary: str) -> DataFrame:
    """The pieces of tails that a sequence end divides, with the checksum of their ids."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame(cut, "_id long, _key long, start long, length long, doc_tokens long, sequence_id long, offset long")
    keys = F.broadcast(wanted.select("_id", "_key").distinct())
    own = _keyed(docs)
    own = own.join(keys, own.doc_id.eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    pieces = own.join(F.broadcast(wanted), own.doc_id.eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))

    def measure(batches):
        codec = tokens(vocabulary)
        for batch in batches:
            sums = []
            for text, start, length in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "length"))):
                ids = np.append(codec(text), np.uint32(END_ID)).astype("<u4")
                sums.append(zlib.crc32(ids[start:start + length].tobytes()))
            yield pa.RecordBatch.from_arrays([
                pa.array(sums, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in columns
            ], columns)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.select("text", *(c for c in columns if c != "ids_crc32")).mapInArrow(measure, ", ".join(f"{c} long" for c in columns))
