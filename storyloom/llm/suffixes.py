"""Removal of long repeated byte strings by sampled suffixes.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too is
removed. Only the first ``LENGTH`` bytes of a suffix matter, so the suffix array is
built to that depth, in the steps of the difference-cover construction:

- *Sample.* In place of a fixed cover the sampled positions are chosen by content:
  in each string of ``LENGTH`` bytes the position of its least ``GRAM``-byte hash. Equal
  strings choose the same place, which is what the cover is for, and about one
  position in 77 is sampled instead of one in ten.
- *Name and sort.* A sampled position is named by three pieces: what stands before
  it, its gram, what follows, as far as its strings reach. Positions are grouped by
  the gram's name; where it repeats, by the name of the whole piece.
- *Recurse.* Pieces whose whole name repeats are settled: all their strings repeat.
  Where a gram repeats with different pieces, the single pieces and one occurrence
  of each settled piece go on: starts that lie together in a block of ``BLOCK`` share a
  core of ``LENGTH - BLOCK + 1`` bytes, which is named in turn.
- *Merge the rest.* Where a core repeats, every remaining start is named by its
  ``LENGTH``-byte prefix, and equal prefixes meet.

Names are 64-bit fingerprints, compared only below an equal gram name, in place of
ranks: no step needs one global order. Bitmaps of fixed size (``BITS``) keep what
cannot matter from being moved; they may let more through, the joins decide.

Null and empty texts keep nothing and lose nothing. Rows with equal text, the same
id or not, are occurrences of one another, so they lose every byte when they are
long enough. Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import drop, drop_shuffles, stored
from storyloom.llm.rolling import U, mix, prefix_sums, span_hash

LENGTH, GRAM = 200, 48
WIDTH = LENGTH - GRAM + 1
BLOCK = 20
BITS = 26
#: Window starts handled at once; the place inside fits the low bits of the packed hash.
_STRETCH, _PLACE_BITS = 1 << 22, 24


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, U)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def sampled(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram name, piece name, first start, last start, place) of every sampled position; ``sums`` are those of the text."""
    starts = len(sums) - LENGTH  # of strings of LENGTH bytes
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    grams, lows, highs, places = [], [], [], []
    for base in range(0, starts, _STRETCH):
        end = min(starts, base + _STRETCH)
        at = np.arange(base, end + WIDTH - 1)
        gram = span_hash(sums, at, at + GRAM)
        place = U((1 << _PLACE_BITS) - 1)
        chosen = (_least((gram & ~place) | (at - base).astype(U), WIDTH) & place).astype(np.int64)
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        grams.append(gram[chosen[first]])
        places.append(base + chosen[first])
        lows.append(base + first)
        highs.append(base + np.append(first[1:], len(chosen)) - 1)
    gram, low, high = np.concatenate(grams), np.concatenate(lows), np.concatenate(highs)
    return gram, span_hash(sums, low, high + LENGTH), low, high, np.concatenate(places)


def _passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names >> U(64 - BITS)
    return (bits[at >> U(6)] >> (at & U(63))) & U(1) == 1


def _bitmap(names: DataFrame, column: str) -> bytes:
    """A bitmap of fixed size holding all names of ``column``, as text of its words that have a bit."""
    word = F.shiftrightunsigned(column, 64 - BITS + 6).cast("int")
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - BITS}) & 63 AS INT))")
    words = names.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))

    def gather(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "words": pa.array([batch.column("word").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                "bits": pa.array([batch.column("bits").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            })

    # At most 2**(BITS - 6) words of 12 bytes, in few rows.
    table = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.mapInArrow(gather, "words binary, bits binary").toLocalIterator():
        table[np.frombuffer(r["words"], np.int32)] = np.frombuffer(r["bits"], np.int64)
    return table.tobytes()


def _data(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _signed(names: np.ndarray) -> pa.Array:
    return pa.array(names.view(np.int64))


def _spots(keys: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A name of each place (text, first start)."""
    return mix(keys.view(U) ^ mix(low.astype(U), 3), 4)


def pieces(own: DataFrame, only=None) -> DataFrame:
    """(gram, piece, text_key, low, high, spot) of the sampled positions, those whose gram the bitmap ``only`` lets pass."""
    def read(batches):
        bits = None if only is None else np.frombuffer(only.value, U)
        for batch in batches:
            parts, rows = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                part = sampled(prefix_sums(_data(text)))
                if bits is not None and len(part[0]):
                    keep = _passes(bits, part[0])
                    part = tuple(p[keep] for p in part)
                if len(part[0]):
                    parts.append(part)
                    rows.append(np.full(len(part[0]), row))
            if parts:
                gram, piece, low, high = (np.concatenate([p[k] for p in parts]) for k in range(4))
                key = batch.column("text_key").to_numpy()[np.concatenate(rows)]
                yield pa.RecordBatch.from_arrays(
                    [_signed(gram), _signed(piece), pa.array(key), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), _signed(_spots(key, low))],
                    ["gram", "piece", "text_key", "low", "high", "spot"],
                )

    return own.mapInArrow(read, "gram long, piece long, text_key long, low int, high int, spot long")


def _chosen(batches, spots: np.ndarray):
    """(text_key, sums, gram, piece, low, high, place) of each text with sampled positions that the bitmap lets pass.

    Of equal texts in one task the first stands for all: a position that goes on
    is single, or one occurrence of it is enough.
    """
    seen = set()
    for batch in batches:
        for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist()):
            if key in seen:
                continue
            seen.add(key)
            sums = prefix_sums(_data(text))
            found = sampled(sums)
            if len(found[0]):
                keep = _passes(spots, _spots(np.full(len(found[2]), key, np.int64), found[2]))
                if keep.any():
                    yield key, sums, *(x[keep] for x in found)


def _blocks(sums: np.ndarray, gram: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(core name, first start, last start, piece) per block; blocks are counted from the gram back, so equal strings share theirs."""
    near, far = (place - high) // BLOCK, (place - low) // BLOCK
    count = far - near + 1
    ends = np.cumsum(count)
    piece = np.repeat(np.arange(len(low)), count)
    block = np.arange(ends[-1]) - (ends - count)[piece] + near[piece]
    latest = place[piece] - block * BLOCK
    # The bytes that all starts of the block have in common.
    core = mix(span_hash(sums, latest, latest + LENGTH - BLOCK + 1) ^ gram[piece], 8)
    return core, np.maximum(latest - BLOCK + 1, low[piece]), np.minimum(latest, high[piece]), piece


def cores(own: DataFrame, spots) -> DataFrame:
    """(core): the core of every block of the positions that the bitmap ``spots`` lets pass."""
    def read(batches):
        held, size = [], 0
        for _, sums, gram, _, low, high, place in _chosen(batches, np.frombuffer(spots.value, U)):
            held.append(_blocks(sums, gram, low, high, place)[0])
            size += len(held[-1])
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(held))], ["core"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(held))], ["core"])

    return own.mapInArrow(read, "core long")


def prefixes(own: DataFrame, spots, repeated, single) -> DataFrame:
    """(prefix, text_key, at, open): the named prefix of every start in a block whose core the bitmap ``repeated``
    lets pass; ``open`` where the bitmap ``single`` holds the piece, so that it may repeat nowhere as a whole."""
    def read(batches):
        cores_, whole = np.frombuffer(repeated.value, U), np.frombuffer(single.value, U)
        held, size = [], 0

        def sent():
            names, keys, places, opens = (np.concatenate([h[k] for h in held]) for k in range(4))
            return pa.RecordBatch.from_arrays([_signed(names), pa.array(keys), pa.array(places.astype(np.int32)), pa.array(opens)], ["prefix", "text_key", "at", "open"])

        for key, sums, gram, piece, low, high, place in _chosen(batches, np.frombuffer(spots.value, U)):
            core, first, last, owner = _blocks(sums, gram, low, high, place)
            keep = _passes(cores_, core)
            first, last, owner = first[keep], last[keep], owner[keep]
            if not len(first):
                continue
            count = last - first + 1
            ends = np.cumsum(count)
            at = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
            owner = np.repeat(owner, count)
            # The gram's name goes in, so prefixes meet only below equal grams.
            held.append((mix(span_hash(sums, at, at + LENGTH) ^ gram[owner], 9), np.full(len(at), key, np.int64), at, _passes(whole, piece)[owner]))
            size += len(at)
            if size > 100_000:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return own.mapInArrow(read, "prefix long, text_key long, at int, open boolean")


def repeated_starts(own: DataFrame) -> DataFrame:
    """(text_key, low, high): runs of starts whose ``LENGTH``-byte string starts elsewhere too."""
    context = own.sparkSession.sparkContext
    grams = stored(pieces(own).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "suffix-grams")
    held = context.broadcast(_bitmap(grams, "gram"))
    met = stored(pieces(own, held).join(grams, "gram"), "suffix-pieces")
    drop(grams)
    counted = stored(met.groupBy("gram", "piece").agg(F.count("*").alias("n"), F.min("spot").alias("spot")), "suffix-names")
    whole = counted.where("n > 1").select("gram", "piece")
    settled = stored(met.join(whole, ["gram", "piece"], "left_semi").select("text_key", "low", "high"), "suffix-settled")
    drop(met)
    # A gram met before different pieces: the single ones, and one occurrence of each other, are compared further.
    several = stored(counted.groupBy("gram").agg(F.count("*").alias("pieces")).where("pieces > 1").select("gram"), "suffix-several")
    spots = context.broadcast(_bitmap(counted.join(several, "gram", "left_semi"), "spot"))
    single = context.broadcast(_bitmap(counted.where("n = 1"), "piece"))
    drop(counted, several)
    repeated = cores(own, spots).groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    rest = stored(prefixes(own, spots, context.broadcast(_bitmap(repeated, "core")), single), "suffix-prefixes")
    equal = stored(rest.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "suffix-equal")
    # What was shuffled to count prefixes goes before they are shuffled again.
    drop_shuffles(own.sparkSession)
    late = stored(rest.where("open").join(equal, "prefix", "left_semi").select("text_key", F.col("at").alias("low"), F.col("at").alias("high")), "suffix-late")
    drop(rest, equal)
    return settled.union(late)


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``cuts`` per row of ``docs``: cuts are the removed byte ranges (start, stop), in order and apart."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    # Starts of one text meet once, however many rows hold that text.
    starts = repeated_starts(own.select("text_key", "text"))
    runs = starts.groupBy("text_key").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    runs = stored(runs.withColumnRenamed("text_key", "_key"), "suffix-runs")
    drop(starts)
    return own.join(runs, F.col("text_key") == F.col("_key"), "left").select("doc_id", "text", "runs")


def cuts(runs: list | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal removed ranges of a text of ``n`` bytes."""
    if not runs:
        none = np.zeros(0, np.int64)
        return none, none
    low = np.array([r["low"] for r in runs], np.int64)
    high = np.array([r["high"] for r in runs], np.int64) + LENGTH
    change = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
    inside = np.concatenate([[False], np.cumsum(change[:n]) > 0, [False]]).astype(np.int8)
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``."""
    def measure(batches):
        for batch in batches:
            sizes, lost, spans, sums = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                data = _data(text).tobytes()
                start, stop = cuts(runs, len(data))
                kept, at = hashlib.sha256(), 0
                for a, b in zip(start.tolist(), stop.tolist()):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                sizes.append(len(data))
                lost.append(int((stop - start).sum()))
                spans.append(len(start))
                sums.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = removed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
