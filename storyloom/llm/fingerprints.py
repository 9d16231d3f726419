"""Order MinHash document fingerprints, in DataFrame functions only.

The elements of a text are its k-mers of ``WORDS`` words, each with the number of
its occurrence. One hash deals the elements to ``BINS`` bins and orders them there;
of every bin the ``TAKEN`` smallest are selected, put back into text order and
hashed together with the bin. Texts close in edit distance select the same k-mers
in the same order; texts that share words in another order do not.

A fingerprint is the list of these names (24 bits: bin and hash), written as hex.
``likeness`` is the share of bins filled in either text whose names agree; two
texts without words are alike (1), one without words is unlike any other (0).

Null text is empty. Texts of fewer than ``WORDS`` words are one k-mer. Rows that
repeat id and text stand once in the order of documents and are reported each;
rows of one id are ordered by the hash of their text, a null id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACE, stored

WORDS, BINS, TAKEN = 2, 64, 2
_PLACE_BITS, _RANK_BITS = 23, 34
_KEY = ("doc_id", "text_key")


def with_names(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the array of names of column ``text``.

    Every array that a lambda reads is a column of its own, read more than once,
    so that it is computed once per row and not once per element.
    """
    a, b, c, d = (f"_{step}_{name}" for step in "abcd")
    keep = rows.columns
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    rows = rows.withColumn(a, F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.transform(F.sequence(F.lit(0), F.size(a) - WORDS), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(WORDS)]))
    runs = F.when(F.size(a) >= WORDS, runs).otherwise(F.array(F.xxhash64(a)))
    # k-mer and place in one number; sorted, the occurrences of a k-mer follow one another in text order.
    packed = F.transform(runs, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit((1 << 40) - 1)), _PLACE_BITS).bitwiseOR(i.cast("long")))
    rows = rows.withColumn(b, F.sort_array(packed))
    kmer = lambda x: F.shiftrightunsigned(x, _PLACE_BITS)
    starts = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | (kmer(F.get(b, i)) != kmer(F.get(b, i - 1))))
    rows = rows.withColumn(c, starts)

    def element(x: Column, occurrence: Column) -> Column:
        h = F.xxhash64(kmer(x), occurrence)
        return F.shiftleft(h.bitwiseAND(F.lit(BINS * (1 << _RANK_BITS) - 1)), _PLACE_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))

    numbered = F.flatten(F.transform(F.col(c), lambda s, j: F.transform(
        F.slice(b, s + 1, F.coalesce(F.get(c, j + 1), F.size(b)) - s), lambda x, o: element(x, o),
    )))
    rows = rows.withColumn(d, F.sort_array(numbered))
    own_bin = lambda x: F.shiftrightunsigned(x, _PLACE_BITS + _RANK_BITS)
    rank = lambda x: F.shiftrightunsigned(x, _PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # The smallest of each bin stand first in it; the next one belongs to the tuple if it is of the same bin.
    heads = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (own_bin(F.get(d, i)) != own_bin(F.get(d, i - 1))))

    def one(i: Column) -> Column:
        x = F.get(d, i)
        taken = F.filter(F.slice(d, i + 1, TAKEN), lambda y: own_bin(y) == own_bin(x))
        ordered = F.transform(F.sort_array(F.transform(taken, lambda y: F.struct(place(y).alias("at"), rank(y).alias("rank")))), lambda y: y["rank"])
        return (F.shiftleft(own_bin(x), 18).bitwiseOR(F.xxhash64(ordered).bitwiseAND(F.lit((1 << 18) - 1)))).cast("int")

    names = F.when(F.size(a) > 0, F.transform(heads, one)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(name, names).select(*keep, name)


def fingerprint(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    bins = lambda names: F.transform(names, lambda x: F.shiftright(x, 18))
    filled = F.size(F.array_union(bins(one), bins(other)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, other)) / filled)


def _met(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, text_key), null ids equal; ``right`` has them as ``_id``, ``_key``."""
    return left.join(right, left.doc_id.eqNullSafe(right["_id"]) & (left.text_key == right["_key"]), how)


def order_of(own: DataFrame) -> DataFrame:
    """Per distinct (doc_id, text_key): the keys of the document before and after it, in a circle, and a quarter of the one before.

    Ranks are places in range-sorted partitions; only the first and last place of
    each partition meet, so no task sees the whole order.
    """
    ids = own.groupBy(*_KEY).agg(F.first("n_chars").alias("n_chars"))
    ranked = stored(
        ids.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("rank", F.monotonically_increasing_id()), "fingerprint-order",
    )
    parts = ranked.groupBy(F.shiftrightunsigned("rank", 33).alias("part")).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    # As many rows as there are partitions.
    ends = sorted((r["first"], r["last"]) for r in parts.collect())
    after = [(last, ends[(k + 1) % len(ends)][0]) for k, (_, last) in enumerate(ends)]
    jumps = own.sparkSession.createDataFrame(after, "rank long, jump long")
    chain = ranked.join(F.broadcast(jumps), "rank", "left").select(*_KEY, "n_chars", "rank", F.coalesce("jump", F.col("rank") + 1).alias("next_rank"))
    before = chain.select(F.col("next_rank").alias("rank"), F.col("doc_id").alias("prev_id"), F.col("text_key").alias("prev_key"),
                          F.floor(F.col("n_chars") / 4).cast("int").alias("prev_quarter"))
    here = chain.select(F.col("rank"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return stored(here.join(before, "rank").drop("rank"), "fingerprint-chain")


def edited_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, chain): every document with ``n_chars`` and its edited text; who stands before whom."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    chain = order_of(own.select(*_KEY, F.char_length("text").alias("n_chars")))
    # The opening that a document lends to the one before it; equal rows lend it once.
    lent = _met(own, chain).select(
        F.col("prev_id").alias("_id"), F.col("prev_key").alias("_key"), F.substring("text", F.lit(1), F.col("prev_quarter")).alias("lent"),
    ).dropDuplicates(["_id", "_key"])
    n = F.char_length("text")
    rows = _met(own, lent).select(
        *_KEY, "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), "lent").alias("edited"),
    )
    return rows, chain


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``."""
    rows, chain = edited_texts(docs)
    named = with_names(with_names(rows, "text", "names"), "edited", "edited_names")
    signed = stored(named.select(*_KEY, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "names", "edited_names"), "fingerprints")
    following = _met(signed.select(*_KEY, "names").dropDuplicates([*_KEY]), chain).select(
        F.col("prev_id").alias("_id"), F.col("prev_key").alias("_key"), F.col("names").alias("next_names"),
    )
    return _met(signed, following).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("names")).alias("fingerprint"), fingerprint(F.col("edited_names")).alias("edited_fingerprint"),
        likeness(F.col("names"), F.col("edited_names")).alias("near_edited"), likeness(F.col("names"), F.col("next_names")).alias("near_next"),
    )
