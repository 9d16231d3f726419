"""Choosing a merge threshold from pairs known to belong together or apart."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import vectors as V
from storyloom.operators.identity import MAX_HOLDERS, STRONG
from storyloom.session import cut_lineage

HARD_WINDOW_DAYS = 7
BINS = 10000  # score bins per unit: thresholds of four decimals stay exact


def positives(identifiers: DataFrame, kept: DataFrame) -> DataFrame:
    """(a, b, type, value): kept items sharing a strong identifier.

    Groups hold two to eight items, so a group gives at most 28 pairs; larger
    ones are categories and are left out before the self-join.
    """
    held = identifiers.where(F.col("type").isin(*STRONG)).join(kept.select("item_id"), "item_id", "left_semi")
    sizes = held.groupBy("type", "value").agg(F.count("*").alias("n")).where(F.col("n").between(2, MAX_HOLDERS))
    members = held.join(sizes.select("type", "value"), ["type", "value"])
    left = members.select("type", "value", F.col("item_id").alias("a"))
    right = members.select("type", "value", F.col("item_id").alias("b"))
    return left.join(right, ["type", "value"]).where("a < b").select("a", "b", "type", "value")


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, place): places from 0 in the order of ``keys``.

    A place is one inside a range-sorted partition plus the rows of the partitions
    before; only one count per partition is collected.
    """
    sorted_ = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    sorted_ = cut_lineage(sorted_.select(*keys, F.shiftrightunsigned("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")))
    before, starts = 0, []
    for r in sorted(sorted_.groupBy("part").count().collect()):
        starts.append((r["part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "part long, before long")
    return sorted_.join(F.broadcast(offsets), "part").select(*keys, (F.col("before") + F.col("inside")).alias("place"))


def random_pairs(kept: DataFrame, count: int, seed: int = 7) -> DataFrame:
    """The distinct unordered pairs among ``count`` draws of two kept items, the same for a seed.

    Either side of a draw is a hash of its number, taken as the place of an item;
    draws of one item twice give no pair.
    """
    items = cut_lineage(numbered(kept, "item_id"))
    n = max(1, items.count())

    def side(number: int) -> Column:
        hashed = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:{number}")).cast("binary"))
        return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") % n

    draws = kept.sparkSession.range(count).select(side(0).alias("x_at"), side(1).alias("y_at")).where("x_at <> y_at")
    met = draws.join(items.select(F.col("place").alias("x_at"), F.col("item_id").alias("x")), "x_at").join(
        items.select(F.col("place").alias("y_at"), F.col("item_id").alias("y")), "y_at")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pair_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each pair; pairs with a missing vector drop out."""
    side = lambda n, v: vectors.select(F.col("item_id").alias(n), F.col("embedding").alias(v))
    return pairs.join(side("a", "va"), "a").join(side("b", "vb"), "b").withColumn(
        "score", V.dot(F.col("va"), F.col("vb"))
    ).drop("va", "vb")


def papers(identifiers: DataFrame, kept: DataFrame) -> DataFrame:
    """One kept paper item per preprint: the earliest."""
    held = identifiers.where("type = 'arxiv'").join(kept.where("kind = 'paper'").select("item_id", "at"), "item_id")
    return held.groupBy("value").agg(F.min(F.struct("at", "item_id")).alias("p")).select("p.item_id", "p.at")


_BIN = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("pairs", T.LongType())])


def _close(tile: pa.Table, window: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Both sides of a tile, their scores, and which of these are of a pair within the window."""
    earlier = tile.column("earlier")
    left, right = tile.filter(earlier), tile.filter(pc.invert(earlier))
    if not left.num_rows or not right.num_rows:
        return left, right, np.zeros((left.num_rows, right.num_rows)), np.zeros((left.num_rows, right.num_rows), bool)
    col = lambda t, n: t.column(n).to_numpy()
    gap = col(right, "at")[None, :] - col(left, "at")[:, None]
    later = (gap > 0) | ((gap == 0) & (col(right, "item_id")[None, :] > col(left, "item_id")[:, None]))
    scores = V.as_matrix(left.column("embedding")) @ V.as_matrix(right.column("embedding")).T
    return left, right, scores, later & (gap <= window)


def _tile_bins(window: int):
    schema = pa.schema([("bin", pa.int32()), ("pairs", pa.int64())])

    def bins(tile: pa.Table) -> pa.Table:
        _, _, scores, close = _close(tile, window)
        place, n = np.unique(np.floor(np.round(scores[close] * BINS, 6)).astype(np.int32), return_counts=True)
        return pa.table({"bin": place, "pairs": n.astype(np.int64)}, schema=schema)

    return bins


def _tile_pairs(window: int, floor: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])

    def pairs(tile: pa.Table) -> pa.Table:
        left, right, scores, close = _close(tile, window)
        x, y = np.nonzero(close & (scores >= floor))
        one, other = left.column("item_id").to_numpy()[x], right.column("item_id").to_numpy()[y]
        return pa.table({"a": np.minimum(one, other), "b": np.maximum(one, other), "score": scores[x, y]}, schema=schema)

    return pairs


def _tiles(items: DataFrame, window: int, block_rows: int) -> GroupedData:
    """Items grouped so that each pair within the window meets in one tile of two bounded blocks."""
    rows = items.where("embedding IS NOT NULL").withColumn("bucket", F.floor(F.col("at") / window))
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    placed = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")))
    own = ["item_id", "at", "embedding"]
    # The later item of a pair is in the same bucket or the next one.
    spans = placed.select(*own, F.col("bucket").alias("home"), F.col("block").alias("side"))
    spans = spans.withColumn("bucket", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    left = spans.join(sizes, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    back = sizes.select(F.col("bucket").alias("home"), F.col("blocks").alias("sides"))
    right = placed.withColumn("home", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))).join(back, "home")
    right = right.withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    tile = ["home", "side", "bucket", "block"]
    both = left.select(*tile, *own, F.lit(True).alias("earlier")).unionByName(
        right.select(*tile, *own, F.lit(False).alias("earlier"))
    )
    return both.groupBy(*tile)


def close_pair_bins(items: DataFrame, window_days: int = HARD_WINDOW_DAYS, block_rows: int = 2048) -> DataFrame:
    """(bin, pairs): how many pairs of items within the window score in each bin.

    All pairs of a busy week are compared but never written: a task compares
    two bounded blocks and returns counts by score bin.
    """
    window = window_days * 86400
    counted = _tiles(items, window, block_rows).applyInArrow(_tile_bins(window), _BIN)
    return counted.groupBy("bin").agg(F.sum("pairs").alias("pairs"))


def close_pairs(items: DataFrame, floor: float, window_days: int = HARD_WINDOW_DAYS, block_rows: int = 2048) -> DataFrame:
    """(a, b, score): the pairs of items within the window that score ``floor`` or more.

    The floor has no default: without one these are all pairs of a week, of which
    ``close_pair_bins`` gives the counts.
    """
    window = window_days * 86400
    return _tiles(items, window, block_rows).applyInArrow(_tile_pairs(window, floor), "a long, b long, score double")


def summary(scores: DataFrame, shares: tuple[float, ...] = (0.05, 0.5, 0.95), names: tuple[str, ...] = ("p5", "median", "p95")) -> DataFrame:
    """n, extremes and linearly interpolated quantiles of a score column; rows without a score do not count.

    Scores get their rank by range, equal ones split by a hash of their row, so that
    a score many rows have is not one partition; of all rows only the two next to
    each wanted rank meet. Without scores the row has n 0 and nulls.
    """
    rows = scores.where("score IS NOT NULL").select("score", F.xxhash64(*scores.columns).alias("deal"))
    placed = numbered(rows, "score", "deal")
    n = placed.agg(F.coalesce(F.max("place") + 1, F.lit(0)).alias("n")).first()["n"]
    at = [share * (n - 1) for share in shares]
    ends = sorted({0, n - 1} | {f(x) for x in at for f in (math.floor, math.ceil)})
    of = lambda place: F.max(F.when(F.col("place") == place, F.col("score")))
    between = [(of(math.floor(x)) + (of(math.ceil(x)) - of(math.floor(x))) * (x - math.floor(x))).alias(name) for x, name in zip(at, names)]
    return placed.where(F.col("place").isin(*ends)).agg(of(0).alias("min"), *between, of(n - 1).alias("max")).select(F.lit(n).cast("long").alias("n"), "min", *names, "max")


def trade_off(positive: DataFrame, hard_bins: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold the positives caught and the hard pairs merged by mistake."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    share = positive.select("score", grid).groupBy("threshold").agg(
        F.count_if(F.col("score") >= F.col("threshold")).alias("caught"), F.count("*").alias("positives")
    )
    wrong = hard_bins.select("bin", "pairs", grid).groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(F.col("bin") >= F.round(F.col("threshold") * BINS), F.col("pairs"))), F.lit(0)).alias("false_merges"),
        F.sum("pairs").alias("hard_pairs"),
    )
    joined = share.join(wrong, "threshold", "full_outer")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("caught", "positives", "false_merges", "hard_pairs")]
    return joined.select("threshold", *filled).withColumn(
        "recall", F.when(F.col("positives") > 0, F.col("caught") / F.col("positives")).otherwise(F.lit(0.0))
    )
