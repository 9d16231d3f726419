"""The topic graph: vectors of topics, related topics, edges.

A picture holds the topics of the tree and, for a reader who has some, that
reader's own topics. Rows without a ``reader`` are the tree's picture alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from storyloom.functions import vectors as V
from storyloom.operators.scoring import best_places
from storyloom.session import cut_lineage

MIN_LIFT, SOURCES_PER_TOPIC = 1.0, 4
BLOCK_ROWS = 1024
TREE = "tree"

NODE = ["reader", "key", "kind", "depth", "parent", "vector"]


def topic_vectors(story_places: DataFrame, centroids: DataFrame) -> DataFrame:
    """Per place the mean direction of the packed centroids of all stories in or below it."""
    rows = story_places.join(centroids.select("story_id", V.packed(F.col("centroid")).alias("packed")), "story_id")
    return V.mean_direction(rows.select("place", F.col("packed").cast("array<double>").alias("packed")), ["place"], "packed", "vector")


def nodes(spine: DataFrame, tree: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, kind, depth, parent, vector) of the topics that have stories."""
    depth = tree.groupBy("slug").agg((F.max("distance") + 1).alias("depth"))
    shelves = spine.where("parent IS NOT NULL").select(F.col("parent").alias("slug")).distinct().withColumn("shelf", F.lit(True))
    rows = spine.select("slug", "parent").join(depth, "slug").join(shelves, "slug", "left").join(vectors, F.col("slug") == vectors["place"])
    return rows.select(F.col("slug").alias("key"), F.when(F.col("shelf"), "branch").otherwise("leaf").alias("kind"), "depth", "parent", "vector")


def own_nodes(topics: DataFrame, fitting: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nodes of readers' own topics (``topics``: reader, topic_key, definition, vector).

    A node lies at the mean of the stories that fit its definition (``fitting``:
    definition, story_id), computed once for all topics that say the same; without
    stories at the topic's own vector, and without either there is no node.
    """
    means = topic_vectors(fitting.select(F.col("definition").alias("place"), "story_id"), centroids).withColumnRenamed("vector", "mean")
    said = V.unit_of_made(V.packed(F.col("vector")).cast("array<double>"))
    # The test reads both columns as they are, so that what is made of them is made once.
    rows = topics.join(means, F.col("definition") == F.col("place"), "left").where("mean IS NOT NULL OR vector IS NOT NULL").withColumn("at", F.coalesce("mean", said))
    return rows.select("reader", F.concat(F.lit("own:"), "topic_key").alias("key"), F.lit("own").alias("kind"), F.lit(1).alias("depth"),
                       F.lit(None).cast("string").alias("parent"), F.col("at").alias("vector"))


_PARTIAL = T.StructType([
    T.StructField("reader", T.LongType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("mean", T.DoubleType()), T.StructField("deviation", T.DoubleType()),
    T.StructField("best", T.ArrayType(T.StructType([T.StructField("other", T.StringType()), T.StructField("score", T.DoubleType())]))),
])


def _codes(left: pa.Table, right: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of both as numbers, equal where the values are; null is -1."""
    both = pa.chunked_array([*left.column(column).chunks, *right.column(column).chunks], left.column(column).type).combine_chunks()
    numbers = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return numbers[:left.num_rows], numbers[left.num_rows:]


def _weights(left: pa.Table, right: pa.Table) -> np.ndarray:
    """How many comparable nodes a row of ``right`` stands for; of the row of the same key one less, the node itself.

    Own topics go with anything; topics of the tree with those of their depth, but below the top not with their siblings.
    """
    (key_a, key_b), (depth_a, depth_b), (parent_a, parent_b) = (_codes(left, right, c) for c in ("key", "depth", "parent"))
    own = lambda t: pc.equal(t.column("kind"), "own").to_numpy()
    top = left.column("depth").to_numpy() == 1
    placed = (depth_a[:, None] == depth_b[None, :]) & (top[:, None] | (parent_a[:, None] != parent_b[None, :]))
    times = right.column("times").to_numpy()[None, :] - (key_a[:, None] == key_b[None, :])
    return np.where(own(left)[:, None] | own(right)[None, :] | placed, times, 0)


def _partial(readers: pa.Array, keys: pa.Array, scores: np.ndarray, weights: np.ndarray, others: pa.Array, n: int) -> pa.Table:
    """Of each row of ``scores`` the number, mean, squared deviations and ``n`` best of its columns, each counted as often as ``weights`` says."""
    allowed, count = weights > 0, weights.sum(1)
    mean = (weights * scores).sum(1) / np.maximum(count, 1)
    deviation = weights * (scores - mean[:, None]) ** 2
    places = best_places(np.where(allowed, scores, -np.inf), n)
    held = np.minimum(allowed.sum(1), places.shape[1])
    taken = np.arange(places.shape[1])[None, :] < held[:, None]
    flat = places[taken]
    best = pa.StructArray.from_arrays([others.take(pa.array(flat)), pa.array(scores[np.nonzero(taken)[0], flat])], ["other", "score"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), best)
    return pa.Table.from_arrays([readers, keys, pa.array(count), pa.array(mean), pa.array(deviation.sum(1)), lists], names=_PARTIAL.names)


def _meet(n: int, back: bool):
    schema = to_arrow_schema(_PARTIAL)

    def meet(tile: pa.Table) -> pa.Table:
        asks = tile.column("asks")
        left, right = tile.filter(asks), tile.filter(pc.invert(asks))
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        # In order, so that equal scores go to the first key.
        left, right = left.sort_by([("reader", "ascending"), ("key", "ascending")]), right.sort_by("key")
        # Pair by pair, so that equal vectors have equal scores wherever they stand in a tile.
        scores = np.einsum("ik,jk->ij", V.as_matrix(left.column("vector")), V.as_matrix(right.column("vector")))
        weights = _weights(left, right)
        column = lambda t, c: t.column(c).combine_chunks()
        found = [_partial(column(left, "reader"), column(left, "key"), scores, weights, column(right, "key"), n)]
        if back:
            readers = left.column("reader").to_numpy()
            starts = np.flatnonzero(np.r_[True, readers[1:] != readers[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(readers)]):
                of = pa.array(np.full(right.num_rows, readers[a], np.int64))
                found.append(_partial(of, column(right, "key"), scores[a:b].T, weights[a:b].T, column(left.slice(a, b - a), "key"), n))
        return pa.concat_tables([t.cast(schema) for t in found])

    return meet


def _tiles(asking: DataFrame, asked: DataFrame, n: int, block_rows: int, back: bool = False) -> DataFrame:
    """Partial results of the ``asking`` nodes against the ``asked`` ones of their scope, a block against a block.

    Both have NODE, ``scope`` and ``deal``, a number that says which rows keep together,
    and may have ``times``, how many nodes of one vector a row stands for (else one). With
    ``back`` the asked nodes also get theirs, for every reader among the asking.
    """
    sizes = lambda rows, out: rows.groupBy("scope").agg(F.ceil(F.count("*") / block_rows).alias(out))
    n_left, n_right = sizes(asking, "lefts"), sizes(asked, "rights")
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    own = lambda of: F.pmod(F.col("deal"), F.col(of))
    sized = lambda rows: rows.join(n_left, "scope").join(n_right, "scope")
    times = lambda rows: F.col("times") if "times" in rows.columns else F.lit(1).cast("long").alias("times")
    left = sized(asking).select(*NODE, times(asking), "scope", own("lefts").alias("lb"), each("rights").alias("rb"), F.lit(True).alias("asks"))
    right = sized(asked).select(*NODE, times(asked), "scope", each("lefts").alias("lb"), own("rights").alias("rb"), F.lit(False).alias("asks"))
    return left.unionByName(right).groupBy("scope", "lb", "rb").applyInArrow(_meet(n, back), _PARTIAL)


def _merged(partials: DataFrame, n: int) -> DataFrame:
    """Partial results as one per node, with the ``n`` best, best first, equal ones by key."""
    parts = partials.where("n > 0").groupBy("reader", "key").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "mean", "deviation")).alias("parts"), F.flatten(F.collect_list("best")).alias("best"),
    )
    # Deviations from a part's own mean, and of that from the mean of all: nothing large is subtracted.
    off = lambda p: p["mean"] - F.col("mean")
    deviation = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["deviation"] + p["n"] * off(p) * off(p))
    return parts.select("reader", "key", "n", "mean", deviation.alias("deviation"), _best_first(F.col("best"), n).alias("best"))


def _best_first(found: Column, n: int) -> Column:
    order = F.array_sort(F.transform(found, lambda b: F.struct((-b["score"]).alias("minus"), b["other"].alias("other"), b["score"].alias("score"))))
    return F.transform(F.slice(order, 1, n), lambda b: F.struct(b["other"].alias("other"), b["score"].alias("score")))


def _standing_out(partials: DataFrame, n: int) -> DataFrame:
    """(reader, key, other, score, lift): partial results merged; the ``n`` best that stand out from all compared ones."""
    found = _merged(partials, n).withColumn("sd", F.sqrt(F.col("deviation") / F.col("n"))).where("n >= 2 AND sd >= 1e-6")
    rows = found.select("reader", "key", "mean", "sd", F.explode("best").alias("b"))
    lifted = rows.select("reader", "key", "b.other", "b.score", ((F.col("b.score") - F.col("mean")) / F.col("sd")).alias("lift"))
    return lifted.where(F.col("lift") >= MIN_LIFT - 1e-9)


def _scope() -> Column:
    return F.coalesce(F.col("reader").cast("string"), F.lit(TREE))


def _inside(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """Partial results of the nodes of every scope against each other.

    Nodes that say the same lie at one place: places meet, and a place counts for all
    its nodes. A scope where a key comes more than once, or is missing, meets node by node.
    """
    rows = cut_lineage(rows)
    unclear = cut_lineage(rows.groupBy("scope", "key").agg(F.count("*").alias("n")).where("n > 1 OR key IS NULL").select("scope").distinct())
    apart = rows.join(unclear, "scope", "left_semi")
    return _tiles(apart, apart, n, block_rows).unionByName(_by_place(rows.join(unclear, "scope", "left_anti"), n, block_rows))


def _by_place(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """The same for scopes of clear keys; a place goes by its first key."""
    same = ["scope", "reader", "kind", "depth", "parent", "vector"]
    places = cut_lineage(rows.groupBy(*same).agg(F.count("*").alias("times"), F.min("key").alias("key")).withColumn("deal", F.xxhash64("key")))
    at = places.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("key").alias("first"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    members = cut_lineage(rows.join(at, on).select("scope", "reader", "key", "first"))
    # One more than asked for: a node leaves itself out.
    merged = cut_lineage(_merged(_tiles(places, places, n + 1, block_rows), n + 1).withColumn("scope", _scope()).withColumnRenamed("key", "first"))
    nth = F.row_number().over(Window.partitionBy("scope", "first").orderBy("key"))
    keys = members.select("scope", "first", "key", nth.alias("nth")).where(F.col("nth") <= n + 1).select("scope", F.col("first").alias("near"), F.col("key").alias("other"))
    near = merged.select("scope", "first", F.explode("best").alias("b")).select("scope", "first", F.col("b.other").alias("near"), F.col("b.score").alias("score"))
    best = near.join(keys, ["scope", "near"]).groupBy("scope", "first").agg(_best_first(F.collect_list(F.struct("other", "score")), n + 1).alias("best"))
    found = merged.drop("best", "reader").join(best, ["scope", "first"])
    others = F.slice(F.filter("best", lambda b: b["other"] != F.col("key")), 1, n).alias("best")
    return members.join(found, ["scope", "first"]).select("reader", "key", "n", "mean", "deviation", others)


def _framed(node_rows: DataFrame) -> DataFrame:
    reader = F.col("reader").cast("long") if "reader" in node_rows.columns else F.lit(None).cast("long")
    return node_rows.select(reader.alias("reader"), "key", "kind", F.col("depth").cast("int").alias("depth"), "parent", F.col("vector").cast("array<double>").alias("vector"))


def closest(node_rows: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(reader, key, other, score, lift): the n nearest comparable nodes that stand out, inside every picture of ``node_rows``.

    Any number of nodes: blocks of places meet in tiles, a tile returns one row per place,
    and how far a node stands out follows from the tiles' means and deviations.
    """
    rows = _framed(node_rows).withColumns({"scope": _scope(), "deal": F.xxhash64("key")})
    return _standing_out(_inside(rows, n, block_rows), n)


def closest_with_own(tree_nodes: DataFrame, own: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same for the tree alone and for every reader's picture of the whole tree and their own topics.

    The tree is no copy per reader: its nodes are compared with each other once, own
    topics of all readers meet it in shared tiles that serve both directions, and own
    topics meet each other inside a reader, those at one place together. A reader of very many topics is split.
    """
    tree = cut_lineage(_framed(tree_nodes).withColumns({"scope": F.lit(TREE), "deal": F.xxhash64("key")}))
    own = cut_lineage(_framed(own))
    chunks = own.groupBy("reader").agg(F.ceil(F.count("*") / block_rows).alias("chunks"))
    shared = own.join(chunks, "reader").withColumns({"scope": F.lit(TREE), "deal": F.xxhash64("reader", F.pmod(F.xxhash64("key"), F.col("chunks")))})
    alone = own.withColumns({"scope": F.col("reader").cast("string"), "deal": F.xxhash64("key")})
    inside = cut_lineage(_tiles(tree, tree, n, block_rows))
    across = cut_lineage(_tiles(shared, tree, n, block_rows, back=True))
    # A reader's tree node also has what the tree gives it.
    seen = across.join(tree.select("key"), "key", "left_semi").select("reader", "key").distinct()
    given = seen.join(inside.drop("reader"), "key").select(*_PARTIAL.names)
    return _standing_out(inside.unionByName(across).unionByName(given).unionByName(_inside(alone, n, block_rows)), n)


def tops(node_rows: DataFrame) -> DataFrame:
    """The nodes an overview links: categories and own topics."""
    return node_rows.where("(kind = 'branch' AND depth = 1) OR kind = 'own'")


def overview_edges(node_rows: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(reader, a, b, strength): each category and own topic to its closest one, every link of a picture once.

    ``own`` adds the pictures of readers with topics of their own, over the whole tree.
    """
    near = closest(tops(node_rows), 1) if own is None else closest_with_own(tops(node_rows), own, 1)
    links = near.select("reader", F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), "key", "lift")
    return links.groupBy("reader", "a", "b").agg(F.min_by("lift", "key").alias("strength"))


def pictures(topics: DataFrame, tree: DataFrame, tree_nodes: DataFrame, own: DataFrame) -> DataFrame:
    """The categories a reader's own picture shows, and their own topics."""
    visible = shown(topics, tree).join(_framed(tops(tree_nodes)).drop("reader"), F.col("slug") == F.col("key"))
    return visible.select(*NODE).unionByName(_framed(own))


def shown(topics: DataFrame, tree: DataFrame) -> DataFrame:
    """(reader, slug) of a reader's own picture: what they follow, inside it, above it."""
    followed = topics.where("spine IS NOT NULL").select("reader", "spine").distinct()
    above = followed.join(tree, followed["spine"] == tree["slug"]).select("reader", F.col("ancestor").alias("slug"))
    below = followed.join(tree, followed["spine"] == tree["ancestor"]).select("reader", "slug")
    return above.unionByName(below).distinct()


def edges(topics: DataFrame, topic_sources: DataFrame, spine: DataFrame, tree: DataFrame, related: DataFrame, scope: str = "mine") -> DataFrame:
    """(reader, a, b, kind): tree, source and related edges of every reader's graph.

    ``related`` are the links of the pictures (reader, a, b). In scope ``all`` what is
    the same for everyone, the tree and its links for readers without own topics,
    comes once, without a reader, instead of once per reader.
    """
    join_up = spine.select("slug", F.coalesce("parent", F.lit("area")).alias("a"))
    if scope == "mine":
        trees = shown(topics, tree).join(join_up, "slug").select("reader", "a", F.col("slug").alias("b"), F.lit("tree").alias("kind"))
    else:
        trees = join_up.select(F.lit(None).cast("long").alias("reader"), "a", F.col("slug").alias("b"), F.lit("tree").alias("kind"))
    rel = related.select("reader", "a", "b", F.lit("rel").alias("kind"))
    first = F.row_number().over(Window.partitionBy("topic_key").orderBy("source"))
    taken = topic_sources.withColumn("n", first).where(F.col("n") <= SOURCES_PER_TOPIC)
    src = taken.join(topics.select("topic_key", "reader", F.coalesce("spine", F.concat(F.lit("own:"), "topic_key")).alias("a")), "topic_key")
    src = src.select("reader", "a", F.concat(F.lit("src:"), "source").alias("b"), F.lit("src").alias("kind"))
    return trees.unionByName(src).unionByName(rel)
