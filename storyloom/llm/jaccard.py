"""N-gram Jaccard join by filtering under several global token orders.

A document's tokens are the hashes of its distinct word shingles. An order ranks
tokens by rarity level first and by a hash of its own second; the levels come from
a counting table of fixed size that every document's tokens are counted in. Two
sets of the wanted similarity share a token among the first ``n - ceil(t n) + 1``
of each under every order, so a pair must meet under all of ``ORDERS`` of them
before its sets are compared. Tokens that only one set has in its prefix tell
more: those before a shared one cannot be in the other set, which bounds the
overlap and removes most pairs in the join itself.

Equal sets are one node. In a first round every prefix token links its sets to
one of them only; what that unites needs no further test among itself. The second
round meets, under every order, only sets of different components. Links are
exact and none between different components is lost; groups are their components.

Null and empty texts, and texts without words, are linked with nothing. Rows that
repeat an id are rows of their own; rows with a null id take the component of
their set, null when no row of it has an id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import drop, small_batches, stored, unused
from storyloom.llm.rolling import U, mix, shingle_groups
from storyloom.operators.cluster import roots

ORDERS = 3
BUCKET_BITS, SLICES = 20, 64
LIVE_BITS = 23


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens, 11) >> U(64 - BUCKET_BITS)).astype(np.int64)


def rarity_levels(docs: DataFrame, words: int) -> bytes:
    """One level per bucket of tokens: 0 for a common count, then one more for each doubling of it.

    Every task counts all tokens of its documents in a table of fixed size; the
    tables are added up slice by slice.
    """
    width = (1 << BUCKET_BITS) // SLICES

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, tokens in shingle_groups(batch.column("text").to_pylist(), words):
                total += np.bincount(_bucket(tokens), minlength=len(total))
        held = [zlib.compress(total[k * width:(k + 1) * width].tobytes(), 1) for k in range(SLICES)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(held, pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, held in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(held), np.int64)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary()),
        })

    counted = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary")
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in counted.collect():
        counts[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    usual = max(1.0, 2 * counts.mean())
    return np.clip(np.floor(np.log2(np.maximum(counts / usual, 1.0))), 0, 15).astype(np.uint8).tobytes()


def _ranks(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """The place of tokens in a global order: rarity level, then the order's own hash."""
    return (levels[_bucket(tokens)].astype(U) << U(60)) | (mix(tokens, 100 + order) >> U(4))


def _prefix(tokens: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set under an order, in that order."""
    take = len(tokens) - -(-percent * len(tokens) // 100) + 1
    if take < len(tokens):
        chosen = np.argpartition(ranks, take - 1)[:take]
        return tokens[chosen[np.argsort(ranks[chosen])]]
    return tokens[np.argsort(ranks)]


def _set_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A name of 64 bits for each set; sets without tokens have none of their own."""
    size = np.diff(bounds)
    full = size > 0
    keys = np.zeros(len(size), U)
    if full.any():
        at = bounds[:-1][full]
        keys[full] = mix(np.add.reduceat(mix(tokens, 5), at) ^ size[full].astype(U), 6) ^ np.bitwise_xor.reduceat(mix(tokens, 7), at)
    return keys.view(np.int64)


MARKS = ("m0", "m1", "m2", "m3")


def _marks(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """256 bits per set, one per bucket of tokens, by parity: sets differ in at least as many tokens as their marks in bits."""
    k = len(bounds) - 1
    owner = np.repeat(np.arange(k), np.diff(bounds))
    odd = np.bincount(owner * 256 + (tokens & U(255)).astype(np.int64), minlength=k * 256) & 1
    return np.packbits(odd.astype(np.uint8).reshape(k, 256), axis=1, bitorder="little").view(np.int64)


def _sketch(tokens: np.ndarray) -> bytes:
    """Marks as ``_marks`` that grow with the set, at least two bits per token; empty where those say it already."""
    bits = 1 << (2 * len(tokens) - 1).bit_length()
    if bits <= 64 * len(MARKS):
        return b""
    odd = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(one: bytes, other: bytes) -> int:
    """Tokens that two sets differ in at least, by their sketches; the longer is folded to the shorter's length."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    if not len(x):
        return 0
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _signed(tokens: np.ndarray) -> list:
    return tokens.view(np.int64).tolist()


def described(docs: DataFrame, levels, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, set_key, n, marks, sketch, prefix) per row; the key is null and the prefix empty without words."""
    def read(batches):
        table = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            keys, sizes, prefixes, sketches, marks = [], [], [], [], [np.zeros((0, 4), np.int64)]
            for _, bounds, tokens in shingle_groups(batch.column("text").to_pylist(), words):
                ranks, size = _ranks(tokens, table, 0), np.diff(bounds)
                keys += [key if n else None for key, n in zip(_set_keys(tokens, bounds).tolist(), size.tolist())]
                sizes += size.tolist()
                marks.append(_marks(tokens, bounds))
                sketches += [_sketch(tokens[a:b]) if a < b else b"" for a, b in zip(bounds[:-1], bounds[1:])]
                prefixes += [_signed(_prefix(tokens[a:b], ranks[a:b], percent)) if a < b else [] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                 *(pa.array(np.concatenate(marks)[:, k]) for k in range(4)), pa.array(sketches, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "set_key", "n", *MARKS, "sketch", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(read, "doc_id long, text_key long, set_key long, n long, m0 long, m1 long, m2 long, m3 long, sketch binary, prefix array<long>")


def _live_bits(live: DataFrame) -> bytes:
    """A bitmap of fixed size that holds the hashes of the nodes' first ids; it may let others pass."""
    h = F.xxhash64("first_id")
    word = F.shiftrightunsigned(h, 64 - LIVE_BITS + 6)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64(first_id), {64 - LIVE_BITS}) & 63 AS INT))")
    rows = live.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    bits = np.zeros(1 << (LIVE_BITS - 6), np.int64)
    for r in rows:
        bits[r["word"]] = r["bits"]
    return bits.tobytes()


def whole_sets(docs: DataFrame, live: DataFrame, levels, words: int, percent: int) -> DataFrame:
    """(node, n, tokens, prefixes) of the nodes ``live`` (node, first_id). ``prefixes`` are those of the orders after the first.

    Only documents that pass the bitmap of the live nodes' first ids are read into
    sets, so other copies of a node are never moved.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(_live_bits(live))

    def read(batches):
        table, bits = np.frombuffer(levels.value, np.uint8), np.frombuffer(bitmap.value, U)
        for batch in batches:
            place = batch.column("h").to_numpy().view(np.uint64) >> U(64 - LIVE_BITS)
            passed = np.flatnonzero((bits[place >> U(6)] >> (place & U(63))) & U(1))
            rows, keys, sizes, sets, prefixes = [], [], [], [], []
            texts = batch.column("text").take(pa.array(passed)).to_pylist()
            for first, bounds, tokens in shingle_groups(texts, words):
                ranks, names = [_ranks(tokens, table, k) for k in range(1, ORDERS)], _set_keys(tokens, bounds).tolist()
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if a < b:
                        rows.append(int(passed[first + i]))
                        keys.append(names[i])
                        sizes.append(b - a)
                        sets.append(tokens[a:b].tobytes())
                        prefixes.append([_signed(_prefix(tokens[a:b], rank[a:b], percent)) for rank in ranks])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.list_(pa.int64())))],
                ["first_id", "node", "n", "tokens", "prefixes"],
            )

    doc_id = F.col("doc_id").cast("long")
    found = docs.where(F.col("doc_id").isNotNull()).select(doc_id.alias("doc_id"), F.xxhash64(doc_id).alias("h"), "text").mapInArrow(
        read, "first_id long, node long, n long, tokens binary, prefixes array<array<long>>")
    return found.join(live, ["first_id", "node"], "left_semi").drop("first_id").dropDuplicates(["node"])


def _shared(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` (node, n, prefix) -> (token, node, n, most): tokens that several prefixes hold, with
    the overlap that the node can still have with a set that meets it there."""
    tokens = prefixes.select("node", "n", F.posexplode("prefix").alias("place", "token"))
    several = stored(tokens.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token"), "jaccard-shared")
    kept = tokens.join(several, "token")
    # Tokens passed over on the way are in no other prefix, so not in a set that meets this one here.
    met = F.row_number().over(Window.partitionBy("node").orderBy("place")) - 1
    shared = stored(kept.select("token", "node", "n", (F.col("n") - F.col("place") + met).alias("most")), "jaccard-tokens")
    drop(several)
    return shared


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length filter and overlap bound of two rows of ``_shared``."""
    n = lambda x: F.col(f"{x}.n")
    needed = F.ceil((n(a) + n(b)) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-6))
    return (F.least(n(a), n(b)) * 100 >= F.greatest(n(a), n(b)) * percent) & (F.least(F.col(f"{a}.most"), F.col(f"{b}.most")) >= needed)


def _differ_little(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose marks, then sketches, differ in no more bits than the sets of a link may differ in tokens.

    The marks of a long set are full whatever it holds; its sketch still tells, and only pairs that pass the marks move sketches.
    """
    side = lambda at: nodes.select(F.col("node").alias(at), F.struct("n", *MARKS).alias(f"{at}_m"))
    bits = sum((F.bit_count(F.col(f"a_m.{m}").bitwiseXOR(F.col(f"b_m.{m}"))) for m in MARKS), F.lit(0))
    total = F.col("a_m.n") + F.col("b_m.n")
    needed = F.ceil(total * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-6))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(bits <= total - 2 * needed).select("a", "b", (total - 2 * needed).alias("may")).distinct()

    def compare(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("one", "other", "may"))
            at = pa.array([row for row, (one, other, may) in enumerate(zip(*columns)) if _apart(one, other) <= may], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    sketch = lambda at, name: nodes.select(F.col("node").alias(at), F.col("sketch").alias(name))
    met = close.join(sketch("a", "one"), "a").join(sketch("b", "other"), "b")
    return met.select("a", "b", "may", "one", "other").mapInArrow(compare, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    def verify(batches):
        for batch in batches:
            keep = []
            for row, (one, other) in enumerate(zip(batch.column("one").to_pylist(), batch.column("other").to_pylist())):
                x, y = np.frombuffer(one, U), np.frombuffer(other, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(row)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("other")), "b")
    return met.select("a", "b", "one", "other").mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Each round hooks every component to its smallest neighbour and follows the
    hooks to their roots; a round at least halves what is not yet united.
    """
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    label = stored(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "components")
    while True:
        across = edges.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
            label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").where("ca > cb")
        hooks = stored(across.groupBy("ca").agg(F.min("cb").alias("cb")), "component-hooks")
        if hooks.isEmpty():
            return label
        known = label.select("component").distinct()
        parents = known.join(hooks, F.col("component") == F.col("ca"), "left").select(F.col("component").alias("item_id"), F.coalesce("cb", "component").alias("parent"))
        rooted = roots(parents)
        label = stored(label.join(rooted, F.col("component") == F.col("item_id")).select("node", F.col("root").alias("component")), "components")


def _across(tokens: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that may link by a shared prefix token."""
    own = tokens.join(label, "node", "left").select("token", "node", "n", "most", F.coalesce("component", "node").alias("component"))
    met = own.alias("x").join(own.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                              & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", percent))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def similar_pairs(docs: DataFrame, rows: DataFrame, levels, words: int, percent: int) -> DataFrame:
    """(a, b): links between nodes that, with the nodes themselves, give the components."""
    nodes = stored(
        rows.where("set_key IS NOT NULL").groupBy(F.col("set_key").alias("node")).agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", *MARKS, "sketch", "prefix")))
        .where("first_id IS NOT NULL"), "jaccard-nodes",
    )
    first = _shared(nodes)

    def sets_of(pairs: DataFrame, *columns: str) -> DataFrame:
        """``columns`` of the sets of the nodes that some pair names, and of no others."""
        named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct()
        live = stored(named.join(nodes.select("node", "first_id"), "node"), "jaccard-live")
        sets = stored(whole_sets(docs, live, levels, words, percent).select(*columns), "jaccard-sets")
        drop(live)
        return sets

    # Round one: each token leads its sets to the one that can overlap others most.
    lead = first.groupBy("token").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("share"), (-F.col("node")).alias("_"), "node", "n", "most")).alias("l")).select("token", "l.*")
    near = first.alias("x").join(lead.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.node") != F.col("y.node")) & _may_link("x", "y", percent))
    near = stored(near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "jaccard-lead-pairs")
    close = stored(_differ_little(near, nodes, percent), "jaccard-close-pairs")
    sets = sets_of(close, "node", "tokens")
    links = stored(_linked(close, sets, percent), "jaccard-lead-links")
    drop(sets, close)
    label = components(links)

    # Round two: sets of different components, meeting under every order.
    pairs = stored(_differ_little(_across(first, label, percent).join(near, ["a", "b"], "left_anti"), nodes, percent), "jaccard-pairs")
    drop(first, near)
    sets = sets_of(pairs, "node", "n", "tokens", "prefixes")
    for order in range(1, ORDERS):
        own = _shared(sets.select("node", "n", F.get("prefixes", order - 1).alias("prefix")))
        met = stored(pairs.join(_across(own, label, percent), ["a", "b"], "left_semi"), "jaccard-pairs")
        drop(own, pairs)
        pairs = met
    last = stored(_linked(pairs, sets, percent), "jaccard-links")
    drop(sets, pairs, nodes, label)
    return links.union(last)


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) per row of ``docs``."""
    spark = docs.sparkSession
    with small_batches(spark):
        levels = spark.sparkContext.broadcast(rarity_levels(docs, words))
        rows = stored(described(docs, levels, words, percent), "jaccard-rows")
        links = similar_pairs(docs, rows, levels, words, percent)
    label = components(links)
    # A set is a node by its own name, for an id may have several sets; ids come in at the end.
    named = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first_id")).join(
        label, F.col("set_key") == F.col("node"), "left").select("set_key", "first_id", F.coalesce("component", "set_key").alias("component"))
    named = stored(named, "jaccard-sets-of-components")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # Written, so that the join below can split a set that very many rows have.
    named = stored(named.join(least, "component").select("set_key", "component_id"), "jaccard-named")
    return rows.select("doc_id", "text_key", "set_key", "n").join(named, "set_key", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def grouped(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    return _grouped(docs, words, percent).drop("text_key")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document of the smallest id of each group, columns as they came; rows with a null id stay.

    An id with two texts is judged text by text. Rows that repeat id and text stay together or go together.
    """
    one, key = unused(docs.columns, "gone_id"), unused(docs.columns, "gone_key")
    lower = _grouped(docs, words, percent).where("component_id < doc_id").select(F.col("doc_id").alias(one), F.col("text_key").alias(key)).distinct()
    lower = stored(lower, "jaccard-gone")
    return docs.join(lower, (F.col("doc_id").cast("long") == F.col(one)) & (F.xxhash64("text") == F.col(key)), "left_anti")
