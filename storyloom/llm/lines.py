"""Line dedup as an exact set-similarity join, in DataFrame functions only.

A line's set holds its ``WORDS``-word shingles (the whole line when it has fewer
words), lower-cased. A line goes when an earlier line, by (doc_id, text, line
number), has an equal set or one of Jaccard similarity ``THRESHOLD`` or more; the
earlier line counts whether or not it goes itself. Lines without a word stay.

Equal sets meet first, by a partial aggregate that keeps the earliest. Shingles
are then ordered by rarity: the most frequent ones over all lines (a table of
fixed size counts them) come last, the others by hash. Similar sets must share one of
their first ``n - ceil(t * n) + 1`` shingles, have sizes within ``t`` of each
other, and the places of the shared shingle must leave room for enough overlap.
Every set is first compared with the earliest set that holds one of its prefix
shingles; only sets that this does not settle meet the others, so a large group
of near copies costs its size. Marks bound the difference of long sets too, so
that those which share a common shingle only are no candidates. Candidates are
verified on whole shingle sets.

Null text has no lines. Equal rows are one row repeated: each keeps the same
lines. Documents whose every word is removed are dropped by ``dedup``; documents
that had none stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACE, drop, drop_shuffles, stored, unused

WORDS, THRESHOLD = 5, 0.8
#: Shingles are counted in 2**BUCKET_BITS buckets; frequent is a bucket of so many times the mean, and at most so many are.
BUCKET_BITS, TIMES, FREQUENT = 17, 3, 2048
#: Sets above so many shingles have marks of 256 bits, others of 64.
SHORT = 64
MARKS = ("marks", "marks_0", "marks_1", "marks_2")


def shingle_hashes(hashes: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the runs of ``n`` words; one of the whole when there are fewer.

    ``hashes`` must be a column (word hashes), not an expression: it is read many times.
    """
    size = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
    return F.when(size >= n, runs).otherwise(F.array(F.xxhash64(hashes)))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def line_sets(own: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, set): one row per line that has a word.

    With a column ``wanted`` (array of line numbers) in ``own``, of those lines only.
    """
    lines = own.where(F.col("text").isNotNull()).select(*[c for c in own.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    if "wanted" in own.columns:
        lines = lines.where(F.array_contains("wanted", F.col("line_no")))
    # A split at one literal character is much cheaper than one at a pattern; few lines hold other blanks.
    low = F.lower("line")
    plain = F.when(low.rlike(r"[\x09-\x0D]"), F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    hashed = lines.select("doc_id", "text_key", "line_no", F.transform(words, lambda w: F.xxhash64(w)).alias("words")).where(F.size("words") > 0)
    return hashed.select("doc_id", "text_key", "line_no", F.array_distinct(shingle_hashes(F.col("words"))).alias("set"))


def frequent_buckets(sets: DataFrame) -> list[int]:
    """The hash buckets that hold frequent shingles: of all shingles of all lines, those counted ``TIMES`` the mean or more.

    The table of counts has a fixed size and is summed before it is moved; the
    list is at most ``FREQUENT`` long, the fullest first.
    """
    # The outer form: the plain one adds a filter on the array, which would move into the lambda that builds it.
    counts = stored(sets.select(F.explode_outer("set").alias("t")).groupBy(F.shiftrightunsigned("t", 64 - BUCKET_BITS).alias("bucket")).agg(F.count("*").alias("n")), "line-buckets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    full = counts.where(F.col("n") > max(64, TIMES * total / (1 << BUCKET_BITS))).orderBy(F.desc("n"), "bucket").limit(FREQUENT)
    buckets = sorted(r["bucket"] for r in full.select("bucket").collect())
    drop(counts)
    return buckets


def _prefix(tokens: str, frequent: list[int], threshold: float) -> Column:
    """The first shingles in rarity order that a similar set must share one of, as 32-bit names."""
    # A name is 62 bits of the hash; frequent shingles sort last by the bit above.
    buckets = ", ".join(f"{b}L" for b in frequent)
    last = f"IF(shiftrightunsigned(t, {64 - BUCKET_BITS}) IN ({buckets}), {1 << 62}L, 0L)" if frequent else "0L"
    ranked = F.expr(f"sort_array(transform({tokens}, t -> shiftrightunsigned(t, 2) + {last}))")
    n = F.size(tokens)
    take = n - F.ceil(n * threshold - F.lit(1e-9)).cast("int") + 1
    return F.transform(F.slice(ranked, F.lit(1), take), lambda t: (t.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))


def _marks(tokens: str) -> list[Column]:
    """``MARKS``: one bit per element, by parity: two sets differ in at least as many elements as their marks in bits.

    All elements by 64 buckets, then those of each but the last quarter; the quarters only
    of sets above ``SHORT``, whose 64 buckets are full whatever they hold.
    """
    own = lambda bit: f"aggregate({tokens}, 0L, (acc, t) -> acc ^ {bit})"
    bit = "shiftleft(1L, CAST(t & 63 AS INT))"
    return [F.expr(own(bit)).alias("marks")] + [
        F.expr(f"IF(size({tokens}) > {SHORT}, {own(f'IF((t & 192) = {k << 6}, {bit}, 0L)')}, 0L)").alias(f"marks_{k}") for k in range(3)]


def _apart(a: str, b: str) -> Column:
    """Elements that two sets differ in at least, by their marks."""
    bits = [F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}")) for m in MARKS]
    # All elements but those of three quarters are those of the fourth.
    quarters = [*bits[1:], reduce(Column.bitwiseXOR, bits)]
    both_long = F.least(f"{a}.n", f"{b}.n") > SHORT
    return F.when(both_long, reduce(Column.__add__, map(F.bit_count, quarters))).otherwise(F.bit_count(bits[0]))


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(later, earlier) rids that share a prefix shingle and pass the length, place and difference filters."""
    a, b = left.alias("a"), right.alias("b")
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    needed = F.ceil((F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - F.lit(1e-9))
    room = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    fits = (small >= large * threshold - 1e-9) & (room >= needed) & (_apart("a", "b") <= F.col("a.n") + F.col("b.n") - 2 * needed)
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("b.rid") < F.col("a.rid")) & fits).select(
        F.col("a.rid").alias("later"), F.col("b.rid").alias("earlier"),
    ).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose whole sets reach the threshold; ``sets`` is (rid, set)."""
    met = pairs.join(sets.select(F.col("rid").alias("later"), F.col("set").alias("a")), "later").join(
        sets.select(F.col("rid").alias("earlier"), F.col("set").alias("b")), "earlier",
    )
    shared = F.size(F.array_intersect("a", "b"))
    return met.where(shared >= (F.size("a") + F.size("b") - shared) * threshold - 1e-9).select("later", "earlier")


def later_matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, line_no) of the lines to remove.

    Each step is written and what it read is deleted, so the disk holds one step at a time.
    """
    own = keyed(docs)
    sets = line_sets(own)
    frequent = frequent_buckets(sets)
    order = ["doc_id", "text_key", "line_no"]
    rows = stored(sets.select(
        *order, F.size("set").alias("n"), F.xxhash64(F.sort_array("set")).alias("k1"), F.xxhash64(F.lit(7), F.sort_array("set")).alias("k2"),
        *_marks("set"), _prefix("set", frequent, threshold).alias("prefix"),
    ), "line-sets")
    # Equal sets: the earliest line stands for all, the others go for it.
    about = ["n", *MARKS]
    firsts = rows.groupBy("k1", "k2").agg(F.min(F.struct(*order, *about, "prefix")).alias("f")).select("k1", "k2", "f.*")
    firsts = stored(firsts.withColumn("id", F.monotonically_increasing_id()), "line-firsts")
    drop_shuffles(docs.sparkSession)
    same = rows.select("k1", "k2", *order).join(firsts.select("k1", "k2", *[F.col(c).alias(f"f_{c}") for c in order]), ["k1", "k2"])
    is_first = F.struct(*order).eqNullSafe(F.struct(*[F.col(f"f_{c}").alias(c) for c in order]))
    copies = stored(same.where(~is_first).select(*order).distinct(), "line-copies")
    drop(rows)
    # Only shingles that several prefixes hold go on, and only they are given what is known of their lines.
    tokens = firsts.select("id", F.posexplode("prefix").alias("place", "token"))
    several = stored(tokens.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token"), "line-several")
    drop_shuffles(docs.sparkSession)
    met = stored(tokens.join(several, "token", "left_semi"), "line-met")
    drop(several)
    # A line's rank in the order is its number.
    ranks = stored(
        firsts.select("id", *order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()), "line-ranks",
    )
    known = ranks.select("id", "rid").join(firsts.select("id", *about), "id")
    shared = stored(met.join(known, "id").drop("id"), "line-shared")
    drop(met, firsts)
    lead = shared.groupBy("token").agg(F.min(F.struct("rid", *about, "place")).alias("l")).select("token", "l.*")
    near = stored(_candidates(shared, lead, threshold), "line-lead-pairs")
    sized = ranks.select("rid", *order)

    def hits(pairs: DataFrame) -> DataFrame:
        """The rids of ``pairs`` that an earlier line's set matches, by the whole sets of the lines named, from the texts; other lines are not read into sets."""
        named = pairs.select(F.col("later").alias("rid")).union(pairs.select(F.col("earlier").alias("rid"))).distinct()
        named = stored(sized.join(named, "rid"), "line-named")
        per_text = stored(named.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
            F.collect_list("line_no").alias("wanted"),
        ), "line-wanted")
        texts = own.join(per_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        found = line_sets(texts.select("doc_id", "text_key", "text", "wanted"))
        names = named.withColumnsRenamed({"doc_id": "_id", "text_key": "_key", "line_no": "_no"})
        whole = stored(found.join(
            names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("line_no") == F.col("_no")),
        ).select("rid", "set"), "line-whole")
        drop(named, per_text)
        later = stored(_verified(pairs, whole, threshold).select(F.col("later").alias("rid")).distinct(), "line-hits")
        drop(whole)
        return later

    first_hits = hits(near)
    open_ = shared.join(first_hits, "rid", "left_anti")
    rest = stored(_candidates(open_, shared, threshold).join(near, ["later", "earlier"], "left_anti"), "line-rest-pairs")
    drop(shared, near)
    rest_hits = hits(rest)
    gone = sized.join(first_hits.union(rest_hits), "rid", "left_semi").select(*order)
    found = stored(copies.union(gone), "line-gone")
    drop(rest, ranks, copies, first_hits, rest_hits)
    return found


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the removed lines, columns as they came; ``n_chars`` follows the text."""
    one, key, numbers = (unused(docs.columns, name) for name in ("gone_id", "gone_key", "gone_lines"))
    gone = later_matches(docs, threshold).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias(numbers))
    gone = gone.withColumnsRenamed({"doc_id": one, "text_key": key})
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(key)), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(numbers, i)), "\n")
    text = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(kept)
    emptied = F.col(numbers).isNotNull() & ~text.rlike(f"[^{SPACE}]")
    columns = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.where(~emptied).select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no) of every removed line."""
    return later_matches(docs, threshold).select("doc_id", F.col("line_no").cast("long").alias("line_no"))
