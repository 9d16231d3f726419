"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

What a token may be is one of ``CLASSES * MEMBERS`` outcomes. The most frequent
training tokens are outcomes of their own, dealt to classes by frequency; every
other token falls, by hash, into an outcome it shares, where its share is its
count over the outcome's. So

    P(token | before) = P(class | before) * P(member | class, before) * share(token),

and the shares of an outcome, with one unseen token, add up to one. Either softmax
adds up rows of a weight table that hashed features choose: the token before, the
two before together, the one two places before (skip); for members with the class.

Counts cover all training texts. Training goes through all of them once, in
``ROUNDS`` parts: each task takes the weights, improves them over its own texts in
batches (AdaGrad) and returns its update; the updates' mean by tokens is added.
Scoring reads every whole text. Only data of fixed size are broadcast: the weights,
and at most ``HEAD`` most frequent tokens (of at most ``HEAD_BYTES`` bytes) with their
counts. The counts of all other tokens reach the documents by a join.

Null and empty texts have one token, the end. A null ``doc_id`` is in no fold: it
is learned from and not held out. Every row is scored, repeated rows too; other
columns are not read. Without training texts every probability is that of the
smoothed empty counts, so scores stay finite; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from storyloom.llm.common import drop, fold, stored

CLASSES, MEMBERS = 32, 32
OUTCOMES = CLASSES * MEMBERS
#: Outcomes shared by tokens that have none of their own.
SHARED = OUTCOMES // 4
#: Tokens whose counts every task knows, and the longest of them; 262,144 * 32 bytes at most.
HEAD, HEAD_BYTES = 1 << 18, 32
#: Rows of the weight tables, weights a row: 1 and 2 MB.
CLASS_ROWS, MEMBER_ROWS = 1 << 13, 1 << 14
ROUNDS, RATE, START = 2, 1.0, 16.0
#: Bytes of a text taken at a time, positions of a training batch, and distinct tokens a task counts before it writes them.
BLOCK, BATCH, DISTINCT = 1 << 20, 1 << 13, 400_000
END = b""

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, A-Z lower-cased, a stretch at a time; the end is the last token."""
    at = 0
    while len(data) - at > BLOCK:
        cut = _SPACE.search(data, at + BLOCK)
        stop = cut.start() if cut else len(data)
        yield data[at:stop].lower().split()
        at = stop
    yield [*data[at:].lower().split(), END]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py() or b""


# ---- counts ----


def counts(docs: DataFrame) -> DataFrame:
    """(token, n): how often each token occurs in the texts; tasks add up before anything is shuffled."""

    def tally(batches):
        seen: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for data in _texts(batch):
                for words in blocks(data):
                    seen.update(words)
                    if len(seen) > DISTINCT:
                        yield flush()
        yield flush()

    rows = docs.select("text").mapInArrow(tally, "token binary, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def shared_outcome(token: bytes) -> int:
    return OUTCOMES - SHARED + crc32(token) % SHARED


class Outcomes(dict):
    """Place of a known token; of any other one ``-1 - bucket``, its shared outcome's number."""

    def __missing__(self, token: bytes) -> int:
        return -1 - crc32(token) % SHARED


@dataclass
class Vocabulary:
    """The most frequent tokens, most frequent first, and what all counts add up to."""

    tokens: list[bytes]
    times: np.ndarray
    total: int
    distinct: int
    shared_tokens: np.ndarray
    shared_distinct: np.ndarray

    def __post_init__(self):
        own = OUTCOMES - SHARED
        known = np.arange(len(self.tokens))
        # Frequency order dealt in runs: a class holds tokens of like frequency.
        later = np.array([shared_outcome(t) for t in self.tokens[own:]], np.int64)
        self.outcome = np.concatenate([known[:own], later])
        rest = self.outcome >= own
        with np.errstate(divide="ignore"):
            self.share = np.where(rest, np.log10((self.times + 1) / self.shared_size()[np.maximum(self.outcome - own, 0)]), 0.0)
        self.smoothed = np.log10(self.times + 1.0)

    def shared_size(self) -> np.ndarray:
        """What a count plus one is divided by, by shared outcome: an unseen token has a place too."""
        return (self.shared_tokens + self.shared_distinct + 1).astype(float)

    def mass(self) -> np.ndarray:
        """Training tokens of each outcome."""
        own = OUTCOMES - SHARED
        out = np.zeros(OUTCOMES)
        out[:min(own, len(self.times))] = self.times[:own]
        out[own:] = self.shared_tokens
        return out


def _head(counted: DataFrame) -> DataFrame:
    """The most frequent short tokens, ``HEAD`` at most: all whose count is in a class whose and whose higher classes' tokens fit.

    Counts up to 1,024 are classes of their own, larger ones are 64 to a doubling, so the driver sees a few thousand
    numbers, and then only the head, whatever the number of tasks.
    """
    short = counted.where(F.octet_length("token") <= HEAD_BYTES)
    count = F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 64)).cast("int")
    left, least = HEAD, 1 << 30
    for r in sorted(short.groupBy(count.alias("class")).agg(F.count("*").alias("kinds")).collect(), reverse=True):
        left -= r.kinds
        if left < 0:
            break
        least = r["class"]
    return short.where(count >= least)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From (token, n). What comes to the driver has a fixed size: the head, the shared outcomes, two totals."""
    head = _head(counted).select("token", "n").toArrow()
    found = sorted(zip(head.column("n").to_pylist(), head.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    tokens, times = [token for _, token in found], np.array([n for n, _ in found], np.int64)
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    bucket = (F.crc32("token") % SHARED).cast("int")
    shared_tokens, shared_distinct = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        shared_tokens[r.bucket], shared_distinct[r.bucket] = r.n, r.kinds
    for token, n in zip(tokens[:OUTCOMES - SHARED], times):  # these have outcomes of their own
        shared_tokens[crc32(token) % SHARED] -= n
        shared_distinct[crc32(token) % SHARED] -= 1
    return Vocabulary(tokens, times, totals.total, totals.kinds, shared_tokens, shared_distinct)


# ---- the model ----


def _row(first: np.ndarray, second, salt: int, rows: int, base: int) -> np.ndarray:
    """A table row below ``rows`` and not below ``base`` for each pair of numbers."""
    x = first.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA77 & 0xFFFFFFFF)
    x ^= np.asarray(second, np.uint32) * np.uint32(0xC2B2AE3D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return (base + x % np.uint32(rows - base)).astype(np.uint16)


class Model:
    """Two weight tables; row 0 of the one and a row per class of the other hold the plain shares."""

    def __init__(self, classes: np.ndarray, members: np.ndarray):
        self.classes, self.members = classes, members

    @classmethod
    def start(cls, mass: np.ndarray) -> Model:
        """The shares of the outcomes, smoothed, and no weight for any context."""
        mass = mass.reshape(CLASSES, MEMBERS) + 0.5
        classes, members = np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((MEMBER_ROWS, MEMBERS), np.float32)
        classes[0] = np.log(mass.sum(1) / mass.sum())
        members[:CLASSES] = np.log(mass / mass.sum(1, keepdims=True))
        return cls(classes, members)

    def copy(self) -> Model:
        return Model(self.classes.copy(), self.members.copy())

    @staticmethod
    def rows(outcome: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list, list]:
        """The active rows of either table, by what stands one and two places before."""
        group = outcome // MEMBERS
        none = np.zeros(len(outcome), np.uint16)
        classes = [none, _row(one, 0, 1, CLASS_ROWS, 1), _row(one, two, 2, CLASS_ROWS, 1), _row(two, 0, 3, CLASS_ROWS, 1)]
        members = [group.astype(np.uint16), _row(one, group, 4, MEMBER_ROWS, CLASSES)]
        return classes, members

    @staticmethod
    def _scores(table: np.ndarray, rows: list) -> np.ndarray:
        x = table[rows[0]]
        for r in rows[1:]:
            x += table[r]
        x -= x.max(1, keepdims=True)
        return x

    @classmethod
    def _shares(cls, table: np.ndarray, rows: list) -> np.ndarray:
        x = cls._scores(table, rows)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def log10(self, outcome: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 probability of each outcome after the two before it."""
        total, at = np.zeros(len(outcome)), np.arange(len(outcome))
        for table, rows, target in zip((self.classes, self.members), self.rows(outcome, one, two), (outcome // MEMBERS, outcome % MEMBERS)):
            x = self._scores(table, rows)
            total += x[at, target]
            total -= np.log(np.exp(x, out=x).sum(1))
        return total / np.log(10)

    def learn(self, outcome: np.ndarray, one: np.ndarray, two: np.ndarray, seen: tuple[np.ndarray, np.ndarray]) -> None:
        """One gradient step on a batch; ``seen`` are the sums of squares, by row, that slow rows down."""
        at = np.arange(len(outcome))
        for table, rows, target, squares in zip((self.classes, self.members), self.rows(outcome, one, two), (outcome // MEMBERS, outcome % MEMBERS), seen):
            error = self._shares(table, rows)
            error[at, target] -= 1
            for r in rows:
                order = np.argsort(r, kind="stable")
                ranked = r[order]
                starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                step = np.add.reduceat(error[order], starts, axis=0)
                used = ranked[starts]
                slowed = squares[used] + np.einsum("ij,ij->i", step, step)
                squares[used] = slowed
                step *= (RATE / np.sqrt(slowed))[:, None]
                table[used] -= step


class Reader:
    """Texts as outcomes with what stands before them."""

    START_OUTCOME = OUTCOMES  # stands before the first token

    def __init__(self, known: Vocabulary):
        self.known = known
        self.place = Outcomes(zip(known.tokens, range(len(known.tokens))))

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def outcomes(self, places: np.ndarray) -> np.ndarray:
        shared = OUTCOMES - SHARED - 1 - places
        if not len(self.known.tokens):
            return shared
        return np.where(places >= 0, self.known.outcome[np.maximum(places, 0)], shared)


def _before(outcome: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outcome one and two places before each, after the two of ``last``."""
    joined = np.concatenate([last, outcome])
    return joined[1:-1], joined[:-2]


def _pieces(weights: list[np.ndarray]) -> list[bytes]:
    return [p.astype(np.float32).tobytes() for w in weights for p in np.array_split(w, 16)]


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Model:
    """One pass over all texts of ``docs`` in ``rounds`` parts, each improving the mean of the tasks' weights before it.

    An update has a fixed size; updates meet piece by piece, so that a task adds up few pieces whatever their number.
    """
    spark = docs.sparkSession
    model = Model.start(known.mass())
    dictionary = spark.sparkContext.broadcast(known)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for r in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def improve(batches):
            first, reader = held.value, Reader(dictionary.value)
            own = first.copy()
            seen = tuple(np.full(len(t), START, np.float32) for t in (own.classes, own.members))
            ready, size, tokens = [], 0, 0

            def step():
                own.learn(*(np.concatenate([x[k] for x in ready]) for k in range(3)), seen)
                ready.clear()

            for batch in batches:
                for data in _texts(batch):
                    last = np.full(2, Reader.START_OUTCOME)
                    for words in blocks(data):
                        outcome = reader.outcomes(reader.places(words))
                        one, two = _before(outcome, last)
                        last = np.concatenate([last, outcome])[-2:]
                        for at in range(0, len(outcome), BATCH):
                            cut = slice(at, at + BATCH)
                            ready.append((outcome[cut], one[cut], two[cut]))
                            size, tokens = size + len(ready[-1][0]), tokens + len(ready[-1][0])
                            if size >= BATCH:
                                step()
                                size = 0
            if ready:
                step()
            if tokens:
                change = _pieces([own.classes - first.classes, own.members - first.members])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(change)), pa.int32()), pa.array([tokens] * len(change), pa.int64()), pa.array(change, pa.binary())], ["piece", "tokens", "change"])

        def add(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for piece, tokens, change in zip(*(c.to_pylist() for c in batch.columns)):
                    have = sums.setdefault(piece, [0, 0.0])
                    have[0] += tokens
                    have[1] = have[1] + np.frombuffer(change, np.float32).astype(np.float64) * tokens
            for piece, (tokens, total) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["piece", "tokens", "change"])

        fields = "piece int, tokens long, change binary"
        updates = docs.select("doc_id", "text").where(part == r).select("text").mapInArrow(improve, fields)
        met = updates.repartition(32, "piece").mapInArrow(add, fields).collect()
        if met:
            change = [np.frombuffer(row.change, np.float64) / row.tokens for row in sorted(met)]
            classes, members = np.concatenate(change[:16]).reshape(model.classes.shape), np.concatenate(change[16:]).reshape(model.members.shape)
            model = Model((model.classes + classes).astype(np.float32), (model.members + members).astype(np.float32))
    return model


# ---- scores ----


def read_texts(docs: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """One row per document (``token`` null) with what the head decides, and one per token outside the head and document."""
    context = docs.sparkSession.sparkContext
    dictionary, held = context.broadcast(known), context.broadcast(model)
    schema = to_arrow_schema(T.StructType([*docs.select("row", "doc_id").schema.fields, *T._parse_datatype_string(
        "n_tokens long, seen long, base double, score double, token binary, times long").fields]))

    def rate(batches):
        known, model, reader = dictionary.value, held.value, Reader(dictionary.value)
        for batch in batches:
            m, keys, rest = batch.num_rows, batch.column("row").to_pylist(), ([], [], [])
            n, seen, base, score, ready = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m), []

            def judge():
                if ready:
                    outcome, one, two, at = (np.concatenate([x[k] for x in ready]) for k in range(4))
                    score[:] += np.bincount(at, model.log10(outcome, one, two), m)
                    ready.clear()

            def others():
                row, token, times = (pa.array(x, schema.field(name).type) for x, name in zip(rest, ("row", "token", "times")))
                none = [pa.nulls(len(row), schema.field(k).type) for k in range(1, 6)]
                for x in rest:
                    x.clear()
                return pa.RecordBatch.from_arrays([row, *none, token, times], schema=schema)

            size = 0
            for k, data in enumerate(_texts(batch)):
                last, outside = np.full(2, Reader.START_OUTCOME), Counter()
                for words in blocks(data):
                    places = reader.places(words)
                    inside = places >= 0
                    outcome = reader.outcomes(places)
                    one, two = _before(outcome, last)
                    last = np.concatenate([last, outcome])[-2:]
                    for at in range(0, len(outcome), BATCH):
                        cut = slice(at, at + BATCH)
                        ready.append((outcome[cut], one[cut], two[cut], np.full(len(outcome[cut]), k)))
                        size += len(outcome[cut])
                        if size >= BATCH:
                            judge()
                            size = 0
                    n[k] += len(places)
                    seen[k] += inside.sum()
                    if inside.any():
                        base[k] += known.smoothed[places[inside]].sum()
                        score[k] += known.share[places[inside]].sum()
                    outside.update([words[at] for at in np.flatnonzero(~inside)])
                rest[0].extend([keys[k]] * len(outside))
                rest[1].extend(outside)
                rest[2].extend(outside.values())
                if len(rest[0]) > 50_000:
                    yield others()
            judge()
            if rest[0]:
                yield others()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *map(pa.array, (n, seen, base, score)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], schema=schema)

    return docs.mapInArrow(rate, from_arrow_schema(schema))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    training = docs.select("doc_id", "text").where(~held_out)
    counted = stored(counts(training), "lm-counts")
    known = vocabulary(counted)
    model = train(training, known)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    read = stored(read_texts(numbered, known, model), "lm-texts")

    sizes = F.array(*[F.lit(float(x)) for x in known.shared_size()])
    size = F.element_at(sizes, (F.crc32("token") % SHARED + 1).cast("int"))
    n = F.coalesce("n", F.lit(0))
    rest = read.where("token IS NOT NULL").select("row", "token", "times").join(counted, "token", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rest_seen"), F.sum(F.col("times") * F.log10(n + 1)).alias("rest_base"),
        F.sum(F.col("times") * F.log10((n + 1) / size)).alias("rest_score"),
    )
    heads = read.where("token IS NULL").drop("token", "times")
    zero = lambda c: F.coalesce(c, F.lit(0))
    below = float(np.log10(known.total + known.distinct + 1))
    scores = stored(
        heads.join(rest, "row", "left").select(
            "doc_id", held_out.alias("held_out"), "n_tokens", (F.col("seen") + zero("rest_seen")).alias("n_known"),
            F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + zero("rest_base") - F.col("n_tokens") * below).alias("base_score"),
            (F.col("score") + zero("rest_score")).alias("score"),
        ), "lm-scores")
    drop(counted, read)
    return scores
