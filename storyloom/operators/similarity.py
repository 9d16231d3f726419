"""The windowed similarity join: per item its best match within a time window.

The comparison is quadratic in a window by definition. What Spark partitions is
*tiles*: the candidates of a time bucket are split into cells of near vectors and
these into blocks of bounded size; a tile is one block of probes against one block
of candidates, and a task holds one tile whatever share of all rows its bucket
has. A tile gives at most one row per probe, so no pairs are ever written.

Three exact tests remove work, never matches:

- Copies. Equal candidate vectors of a bucket are one candidate with a list of
  times; of those of one second the smallest id is kept, for it precedes the
  others. So a list is at most as long as the window has seconds, and a vector is
  compared once however often it occurs. Equal probes of a tile are compared once.
- Cells. With c a cell's centre and r its radius (both angles), every vector of
  the cell is at least angle(x, c) - r away from x, so a probe x passes over a cell
  where that exceeds acos(floor). Centres are chosen farthest first, until what
  they leave has a small radius or a bucket has a centre for every block.
- Leading coordinates. Vectors are turned to the principal axes of a sample. A dot
  product is at most that of the leading coordinates plus the product of the
  lengths of the rest (Cauchy-Schwarz); only pairs that pass are multiplied out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import vectors as V

BLOCK_ROWS = 4096
#: Centres are broadcast (2 MB of 64 doubles at this number); cells beyond it hold more blocks.
MOST_CENTRES = 4096
SAMPLE_ROWS = 4096
#: A radius below this share of the reach is not worth splitting.
SMALL = 0.25
# Angles and coordinates are floating-point numbers and vectors only nearly of
# length one: more than either can be off, so that no test excludes a match.
SLACK = 1e-3


def unit_rows(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1.0, lengths)


def farthest_first(sample: np.ndarray, count: int, small: float) -> np.ndarray:
    """Up to ``count`` rows of ``sample`` (unit vectors), each the farthest from those before it, until none is ``small`` away."""
    chosen = [0]
    angle = np.arccos(np.clip(sample @ sample[0], -1, 1))
    while len(chosen) < min(count, len(sample)):
        at = int(angle.argmax())
        if angle[at] <= small:
            break
        chosen.append(at)
        angle = np.minimum(angle, np.arccos(np.clip(sample @ sample[at], -1, 1)))
    return sample[chosen]


def leading_axes(sample: np.ndarray, share: int = 4) -> np.ndarray:
    """The principal axes (columns) that come first, a quarter of the dimensions."""
    _, found = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(found[:, ::-1][:, :max(1, sample.shape[1] // share)])


def candidate_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, dot product) of all pairs that reach ``floor``; most others are never multiplied out."""
    rows, columns = surviving(left, right, axes, floor)
    if len(rows) * 4 > len(left) * len(right):
        scores = (left @ right.T)[rows, columns]
    else:
        scores = np.concatenate([np.einsum("ij,ij->i", left[rows[k:k + 65536]], right[columns[k:k + 65536]]) for k in range(0, max(len(rows), 1), 65536)])
    hit = scores >= floor
    return rows[hit], columns[hit], scores[hit]


def surviving(left: np.ndarray, right: np.ndarray, axes: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the pairs whose leading coordinates and lengths allow ``floor``."""
    a, b = left @ axes, right @ axes
    rest = lambda m, lead: np.sqrt(np.maximum((m * m).sum(1) - (lead * lead).sum(1), 0.0))
    bound = a @ b.T
    bound += np.outer(rest(left, a), rest(right, b))
    return np.nonzero(bound >= floor - SLACK * SLACK)


def earliest_members(group: np.ndarray, at: np.ndarray, batch: np.ndarray, ident: np.ndarray, members: dict[str, np.ndarray], window: int) -> np.ndarray:
    """Per (group, probe) the place of the group's first member that precedes the probe within the window, or -1.

    ``members`` are sorted by (group, batch, at), one per time, and give ``group``, ``batch``, ``at``, ``item_id``.
    """
    low = min(int(members["at"].min()), int(at.min()) - window)
    span = max(int(members["at"].max()), int(at.max())) - low + 2
    batches = np.unique(members["batch"])
    kind = lambda g, b: g * (len(batches) + 1) + b
    keys = kind(members["group"], np.searchsorted(batches, members["batch"])) * span + members["at"] - low
    found = np.full(len(group), -1)
    for k, value in enumerate(batches):
        place = np.searchsorted(keys, kind(group, k) * span + at - window - low)
        inside = np.minimum(place, len(keys) - 1)
        when, who = members["at"][inside], members["item_id"][inside]
        fits = (place < len(keys)) & (members["group"][inside] == group) & (members["batch"][inside] == value) & (when <= at + window)
        fits &= (value < batch) | ((value == batch) & ((when < at) | ((when == at) & (who < ident))))
        found = np.where((found < 0) & fits, inside, found)
    return found


_TILE = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("match", T.LongType()),
    T.StructField("match_at", T.LongType()), T.StructField("match_batch", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])
_TILE_ARROW = pa.schema([("item_id", pa.int64()), ("match", pa.int64()), ("match_at", pa.int64()), ("match_batch", pa.int32()), ("score", pa.float64())])


def _tile_best(window: int, floor: float, axes: np.ndarray):
    def best(tile: pa.Table) -> pa.Table:
        is_probe = tile.column("is_probe")
        left, right = tile.filter(is_probe), tile.filter(pc.invert(is_probe))
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=_TILE_ARROW)
        lists = right.column("members").combine_chunks()
        flat = lists.flatten()
        members = {name: flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("batch", "at", "item_id")}
        members["group"] = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.lexsort((members["at"], members["batch"], members["group"]))
        members = {name: values[order] for name, values in members.items()}
        candidates = V.as_matrix(right.column("embedding"))
        # Equal probes are one row of the product.
        distinct, which = np.unique(V.as_matrix(left.column("embedding")), axis=0, return_inverse=True)
        by_row = np.argsort(which.ravel(), kind="stable")
        ends = np.searchsorted(which.ravel()[by_row], np.arange(len(distinct) + 1))
        probe = {name: left.column(name).to_numpy().astype(np.int64)[by_row] for name in ("item_id", "at", "batch")}
        out = []
        for start in range(0, len(distinct), 512):
            rows, columns, scores = candidate_pairs(distinct[start:start + 512], candidates, axes, floor)
            rows = rows + start
            # Every probe of a row against every candidate of the row.
            times = ends[rows + 1] - ends[rows]
            begin = np.cumsum(times) - times
            who = np.repeat(ends[rows] - begin, times) + np.arange(times.sum())
            group, score = np.repeat(columns, times), np.repeat(scores, times)
            if not len(who):
                continue
            member = earliest_members(group, probe["at"][who], probe["batch"][who], probe["item_id"][who], members, window)
            valid = member >= 0
            who, member, score = who[valid], member[valid], score[valid]
            # Rounding first makes copies that differ in the last bit tie; ties go to the earliest.
            rank = np.lexsort((members["item_id"][member], members["at"][member], members["batch"][member], -np.round(score, 9), who))
            first = rank[np.unique(who[rank], return_index=True)[1]]
            out.append(pa.table([
                probe["item_id"][who[first]], members["item_id"][member[first]], members["at"][member[first]],
                members["batch"][member[first]].astype(np.int32), score[first]], schema=_TILE_ARROW))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=_TILE_ARROW)

    return best


def _cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with the nearest centre as ``cell`` and the angle to it."""
    if len(centres) == 1:
        return vectors.withColumn("c", F.struct(F.lit(0).alias("cell"), F.lit(math.pi).alias("angle")))
    spread = np.ascontiguousarray(centres.T)

    @F.arrow_udf("struct<cell:int,angle:double>")
    def nearest(values: pa.Array) -> pa.Array:
        m = V.as_matrix(values)
        if not len(m):
            return pa.array([], pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))
        cos = np.clip(unit_rows(m) @ spread, -1.0, 1.0)
        cell = cos.argmax(1)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.arccos(cos[np.arange(len(m)), cell]))], ["cell", "angle"])

    return vectors.withColumn("c", nearest("embedding"))


def _visited(probes: DataFrame, centres: np.ndarray, radius: np.ndarray, reach: float) -> DataFrame:
    """``probes`` with ``cell``, one row for each cell that can hold a match."""
    if len(centres) == 1:
        return probes.withColumn("cell", F.lit(0))
    spread = np.ascontiguousarray(centres.T)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def near(values: pa.Array) -> pa.Array:
        m = V.as_matrix(values)
        if not len(m):
            return pa.array([], pa.list_(pa.int32()))
        rows, cells = np.nonzero(np.arccos(np.clip(unit_rows(m) @ spread, -1.0, 1.0)) - radius <= reach)
        offsets = np.searchsorted(rows, np.arange(len(m) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.astype(np.int32)))

    return probes.withColumn("cell", F.explode(near("embedding")))


def _sample(vectors: DataFrame, total: int, rows: int) -> np.ndarray:
    """About ``rows`` vectors, chosen by hash and in its order; unit length."""
    key = F.xxhash64("item_id")
    drawn = vectors.select("item_id", "embedding").where(F.pmod(key, F.lit(max(1, total // rows))) == 0).limit(2 * rows)
    found = sorted(drawn.select(key.alias("key"), "embedding").collect())
    return unit_rows(np.array([r.embedding for r in found], dtype=np.float64)) if found else np.zeros((0, 0))


def best_earlier(probes: DataFrame, candidates: DataFrame, window: int, floor: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item_id, match, score): the most similar earlier candidate scoring at least ``floor``.

    Both frames hold (item_id, batch, at, embedding); earlier means a smaller
    (batch, at, item_id); ties go to the earliest candidate.
    """
    keep = ["item_id", "batch", "at", "embedding"]
    bucket = F.floor(F.col("at") / window)
    size = candidates.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("densest")).first()
    count = min(MOST_CENTRES, -(-(size.densest or 0) // block_rows))
    sample = _sample(candidates, size.rows or 0, max(SAMPLE_ROWS, 16 * count)) if size.rows else None
    if sample is None or not len(sample):
        return probes.select("item_id", F.lit(None).cast("long").alias("match"), F.lit(None).cast("double").alias("score")).limit(0)
    reach = math.acos(max(-1.0, min(1.0, floor))) + SLACK
    axes, centres = leading_axes(sample), farthest_first(sample, count, SMALL * reach)

    # One candidate per vector and bucket, with the times it has: one member a second and batch.
    once = candidates.groupBy(bucket.alias("bucket"), "embedding", "batch", "at").agg(F.min("item_id").alias("item_id"))
    once = once.groupBy("bucket", "embedding").agg(F.collect_list(F.struct("batch", "at", "item_id")).alias("members"))
    cand = _cells(once, centres).select("bucket", "c.cell", "c.angle", "embedding", "members")
    shape = cand.groupBy("bucket", "cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    radius = np.zeros(len(centres))
    if len(centres) > 1:
        for r in shape.groupBy("cell").agg(F.max("radius").alias("radius")).collect():
            radius[r.cell] = r.radius
    blocks = shape.select("bucket", "cell", F.ceil(F.col("rows") / block_rows).alias("blocks"))
    placed = cand.join(blocks, ["bucket", "cell"]).withColumn("block", F.pmod(F.xxhash64("embedding"), F.col("blocks")))

    # A probe visits three buckets, and there every block of the cells it cannot rule out.
    probe = _visited(probes.select(*keep), centres, radius, reach)
    spans = probe.withColumn("home", bucket).withColumn("bucket", F.explode(F.sequence(F.col("home") - 1, F.col("home") + 1)))
    near = spans.join(blocks, ["bucket", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    # Probes are split the same way, so that a tile is small on both sides.
    tile = ["bucket", "cell", "block", "part"]
    parts = near.groupBy(*tile[:3]).agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    tiles_left = near.select(*tile[:3], *keep).join(parts, tile[:3]).withColumn("part", F.pmod(F.xxhash64(F.col("item_id"), F.lit(7)), F.col("parts")))
    tiles_right = placed.join(parts, tile[:3]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    fields = {f.name: f.dataType for f in [*tiles_left.schema, *tiles_right.schema]}
    none = lambda name: F.lit(None).cast(fields[name]).alias(name)
    both = tiles_left.select(*tile, *keep, none("members"), F.lit(True).alias("is_probe")).unionByName(
        tiles_right.select(*tile, none("item_id"), none("batch"), none("at"), "embedding", "members", F.lit(False).alias("is_probe"))
    )
    found = both.groupBy(*tile).applyInArrow(_tile_best(window, floor, axes), _TILE)
    earliest = F.struct(F.round("score", 9).alias("s"), (-F.col("match_batch")).alias("b"), (-F.col("match_at")).alias("t"),
                        (-F.col("match")).alias("i"))
    return found.groupBy("item_id").agg(F.max_by(F.struct("match", "score"), earliest).alias("m")).select(
        "item_id", "m.match", "m.score"
    )
