"""What the published bundle holds, as JSON lines by section, and those lines as columns.

Sections: ``story`` and ``items`` (a story's card and its members), ``status``
(one line), ``broken`` (failing sources), ``spine``, ``facets`` and ``vectors``
(how centroids are encoded). ``sources.bundles`` writes and reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X
from storyloom.functions import vectors as V
from storyloom.operators import feed, ingest, tree

ITEMS_PER_LINE = 1000
NEWEST_FIRST = 8640000000000  # after any time, so that what is no story comes first

# Everything a line of any section may hold.
FIELDS = """story_id long, title string, summary string, url string, kind string, source string, sources array<string>, published_at string,
  last_activity string, score double, item_count long, media_url string, centroid string,
  topics array<struct<slug string, name string, parent string, parent_name string, path array<string>>>,
  entities array<struct<kind string, name string>>, engagement struct<points long, comments long>,
  items array<struct<kind string, title string, url string, source string, published_at string>>,
  slug string, name string, parent string, parent_name string, description string, error string,
  stories long, newest_item string, kept long, rejected long, pending long, encoding string, dimension long, scale long"""


def _json(line: Column) -> Column:
    return F.to_json(line, {"ignoreNullFields": "false"})


def _section(df: DataFrame, name: str, line: Column, of_story: bool = False, chunk: str | None = None) -> DataFrame:
    story, newest = (F.col("story_id"), F.col("newest")) if of_story else (F.lit(None), F.lit(NEWEST_FIRST))
    part = F.col(chunk) if chunk else F.lit(0)
    return df.select(F.lit(name).alias("section"), story.cast("long").alias("story_id"), part.cast("long").alias("chunk"), newest.cast("long").alias("newest"), _json(line).alias("line"))


def stories(rows: DataFrame, card_rows: DataFrame, labels: DataFrame, entities: DataFrame, centroids: DataFrame, engagement: DataFrame, summary_limit: int | None = None) -> DataFrame:
    """One line per story: its card, topics, entities (kind, name), packed centroid and loudest thread.

    ``summary_limit`` shortens summaries for readers on slow lines; by default they are whole.
    """
    label = labels.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("slug", "name", "parent", "parent_name", "path"))).alias("topics"))
    named = entities.distinct().groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("name", "kind"))).alias("entities"))
    packed = feed.packed_centroids(centroids).select("story_id", V.packed_text("packed").alias("centroid"))
    full = (
        rows.select("story_id", "newest", "score").join(card_rows, "story_id").join(label, "story_id", "left").join(named, "story_id", "left")
        .join(packed, "story_id", "left").join(engagement, "story_id", "left")
    )
    summary = F.col("summary") if summary_limit is None else X.truncate(F.col("summary"), summary_limit)
    line = F.struct(
        "story_id", "title", summary.alias("summary"), "url", "kind", "source", "sources",
        I.iso(F.col("published_s")).alias("published_at"), I.iso(F.col("newest")).alias("last_activity"), F.round("score", 4).alias("score"),
        "item_count", "media_url", "centroid", F.coalesce("topics", F.array()).alias("topics"),
        F.coalesce(F.transform("entities", lambda e: F.struct(e["kind"].alias("kind"), e["name"].alias("name"))), F.array()).alias("entities"),
        F.when(F.col("points").isNotNull() | F.col("comments").isNotNull(), F.struct("points", "comments")).alias("engagement"),
    )
    return _section(full, "story", line, True)


def story_items(rows: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """The members of each story as lines of at most about a thousand items, in reading order.

    An ordinary story is one line; one with very many items becomes several
    (``chunk``), so no line grows with a story.
    """
    chosen = members.join(rows.select("story_id", "newest"), "story_id")
    sizes = chosen.groupBy("story_id").agg(F.ceil(F.count("*") / ITEMS_PER_LINE).alias("chunks"))
    listed = chosen.join(sizes, "story_id").join(items.select("item_id", "kind", "title", "url", "source", "published_s"), "item_id")
    listed = listed.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.col("chunks")))
    item = F.struct(F.col("published_s").alias("at"), F.col("item_id").alias("id"), F.struct("kind", "title", "url", "source", I.iso(F.col("published_s")).alias("published_at")).alias("item"))
    grouped = listed.groupBy("story_id", "chunk").agg(F.max("newest").alias("newest"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))
    return _section(grouped, "items", F.struct("story_id", "items"), True, "chunk")


def status(items: DataFrame, story_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """One line of totals, and one for each enabled source that fails."""
    states = [F.count_if(F.col("triage_state") == s).alias(s) for s in ("kept", "rejected", "pending")]
    of_items = items.agg(F.lit(0).cast("long").alias("stories"), F.max("at").alias("newest"), *states)
    of_stories = story_rows.agg(F.count("*").alias("stories"), F.lit(None).cast("long").alias("newest"), *[F.lit(0).cast("long").alias(s) for s in ("kept", "rejected", "pending")])
    total = of_items.unionByName(of_stories).agg(*[F.sum(c).alias(c) for c in ("stories", "kept", "rejected", "pending")], F.max("newest").alias("newest_s"))
    totals = _section(total, "status", F.struct("stories", I.iso(F.col("newest_s")).alias("newest_item"), "kept", "rejected", "pending"))
    return totals.unionByName(_section(ingest.broken(sources), "broken", F.struct("name", F.col("last_error").alias("error"))))


def spine(topics: DataFrame) -> DataFrame:
    """Every topic, so that one with no story can still be named; a shelf with its description."""
    return _section(tree.listing(topics), "spine", F.struct("slug", "name", "parent", "parent_name", "description"))


def facets(named: DataFrame) -> DataFrame:
    return _section(named, "facets", F.struct("slug", "name"))


def vectors(spark: SparkSession, dimension: int) -> DataFrame:
    """How the centroids are packed, for a reader to decode them by."""
    line = F.struct(F.lit("int8").alias("encoding"), F.lit(dimension).cast("long").alias("dimension"), F.lit(V.PACK_SCALE).cast("long").alias("scale"))
    return _section(spark.range(1), "vectors", line)


def newest_first(lines: DataFrame) -> DataFrame:
    """Lines in the bundle's order: what is no story, then stories from the newest, each before its items."""
    return lines.orderBy(F.desc("newest"), "story_id", F.desc("section"), "chunk", "line")


def fields(lines: DataFrame) -> DataFrame:
    """Lines of all sections with their fields as columns (null where a section has none)."""
    return lines.select("section", "chunk", F.from_json("line", FIELDS).alias("body")).select("section", "chunk", "body.*")


def rows(lines: DataFrame) -> DataFrame:
    """``fields`` flat: a row per story, per item, per topic of the spine and so on; items take their story's id."""
    each = fields(lines).withColumn("item", F.explode_outer("items"))
    topic = F.get("topics", F.lit(0))
    of_item = [F.coalesce(F.col(f"item.{c}"), F.col(c)).alias(c) for c in ("kind", "title", "url", "source", "published_at")]
    of_topic = [F.coalesce(topic[c], F.col(c)).alias(c) for c in ("slug", "name", "parent", "parent_name")]
    return each.select(
        "section", "story_id", *of_item, *of_topic, "summary", F.array_join("sources", ",").alias("sources"), "last_activity", "score", "item_count", "media_url", "centroid",
        F.array_join(topic["path"], "/").alias("path"), F.array_join(F.transform("entities", lambda e: F.concat(e["kind"], F.lit(":"), e["name"])), ",").alias("entities"),
        "engagement.points", "engagement.comments", "description", "error", "stories", "newest_item", "kept", "rejected", "pending", "encoding", "dimension", "scale",
    )
