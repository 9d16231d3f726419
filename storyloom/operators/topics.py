"""Filing stories: one home each, by claim, by best fit or by category."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import vectors as V
from storyloom.operators import search
from storyloom.operators.scoring import with_best

FLOOR, FALLBACK_FLOOR, PARK_MARGIN, GROUP_SIMILARITY = 0.55, 0.50, 0.02, 0.78


def centroids(story_items: DataFrame, vectors: DataFrame) -> DataFrame:
    return V.mean_direction(story_items.join(vectors.select("item_id", "embedding"), "item_id"), ["story_id"])


def headlines(story_items: DataFrame, items: DataFrame) -> DataFrame:
    """The earliest item's title and kind, per story."""
    rows = story_items.select("story_id", "item_id").join(items.select("item_id", "title", "kind", "at"), "item_id")
    return rows.groupBy("story_id").agg(
        F.min_by(F.struct("title", "kind"), F.struct("at", "item_id")).alias("h")
    ).select("story_id", "h.title", "h.kind")


def claimed(title: Column, kind: Column, claims: list[tuple[str, str]]) -> Column:
    """The first leaf, in order, whose pattern the headline matches; never for a paper.

    Patterns follow Python's verbose dialect, with conditionals other regex
    engines lack, so they run in Python over Arrow batches.
    """
    compiled = [(slug, re.compile(pattern, re.IGNORECASE | re.VERBOSE)) for slug, pattern in claims]

    @F.arrow_udf(T.StringType())
    def claim(titles: pa.Array) -> pa.Array:
        taken = [next((s for s, p in compiled if p.search(t)), None) if t is not None else None for t in titles.to_pylist()]
        return pa.array(taken, pa.string())

    return claim(F.when(kind != "paper", title))


def assign(centroid_rows: DataFrame, headline_rows: DataFrame | None, leaves: DataFrame, tops: DataFrame | None,
           spine: DataFrame, claims: list[tuple[str, str]], floor: float = FLOOR, fallback: float = FALLBACK_FLOOR,
           margin: float = PARK_MARGIN) -> DataFrame:
    """(story_id, home, how, claim): claimed, leaf, parked, category or unmatched.

    ``leaves`` and ``tops`` are (key, vector), ``spine`` (slug, parent): any number of topics.
    """
    rows = with_best(centroid_rows.select("story_id", "centroid"), "story_id", "centroid", leaves, 2, "leaf")
    if claims and headline_rows is not None:
        rows = rows.join(headline_rows.select("story_id", claimed(F.col("title"), F.col("kind"), claims).alias("claim")), "story_id", "left")
    else:
        rows = rows.withColumn("claim", F.lit(None).cast("string"))
    first, second = F.get("leaf", F.lit(0)), F.get("leaf", F.lit(1))
    rows = rows.select("*", first["key"].alias("first_key"), first["score"].alias("first"), second["key"].alias("second_key"), second["score"].alias("second"))
    for place, shelf in (("first_key", "shelf"), ("second_key", "other")):
        rows = rows.join(spine.select(F.col("slug").alias(place), F.col("parent").alias(shelf)), place, "left")
    fits = F.col("first") >= floor
    parks = fits & (F.col("shelf") == F.col("other")) & (F.col("first") - F.col("second") < margin)
    if tops is not None:
        rows = with_best(rows, "story_id", "centroid", tops, 1, "top")
        above = tops.select(F.col("key").alias("shelf"), F.col("vector").alias("shelf_vector"))
        rows = rows.join(above, "shelf", "left").withColumn("above", V.dot(F.col("centroid"), F.col("shelf_vector")))
        best_top = F.get("top", F.lit(0))
        contested, falls, top_key = fits & (F.col("above") > F.col("first")), best_top["score"] >= fallback, best_top["key"]
    else:
        contested = falls = F.lit(False)
        top_key = F.lit(None).cast("string")
    choice = lambda how, home: F.struct(F.lit(how).alias("how"), home.alias("home"))
    decided = (
        F.when(F.col("claim").isNotNull(), choice("claimed", F.col("claim")))
        .when(parks, choice("parked", F.col("shelf")))
        .when(contested, choice("category", F.col("shelf")))
        .when(fits, choice("leaf", F.col("first_key")))
        .when(falls, choice("category", top_key))
        .otherwise(choice("unmatched", F.lit(None).cast("string")))
    )
    return rows.select("story_id", decided.alias("d"), "claim").select("story_id", "d.home", "d.how", "claim")


def run_totals(assigned: DataFrame) -> DataFrame:
    """Stories by outcome and by topic, as (measure, topic, n)."""
    return assigned.groupBy("how", "home").agg(F.count("*").alias("n"))


def explain(assigned: DataFrame, ranked: DataFrame, stored: DataFrame) -> DataFrame:
    """Per story every leaf's score, the lead over the next, and both homes.

    ``ranked`` holds (story_id, leaf), all leaves of a story as (key, score), best first.
    """
    base = assigned.select("story_id", "home").join(ranked.select("story_id", "leaf"), "story_id")
    base = base.join(stored.select("story_id", F.col("slug").alias("stored")), "story_id", "left")
    gap = F.get("leaf", F.lit(0))["score"] - F.get("leaf", F.lit(1))["score"]
    each = base.select("story_id", "home", "stored", gap.alias("margin"), F.posexplode("leaf").alias("place", "l"))
    return each.select("story_id", "home", "stored", "margin", (F.col("place") + 1).alias("place"),
                       F.col("l.key").alias("leaf"), F.col("l.score").alias("score"))


def find_story(keys: DataFrame, stories: DataFrame, story_items: DataFrame, items: DataFrame) -> DataFrame:
    """(key, story_id): a story by number, or the newest with a title holding the text, whatever the number of keys."""
    numeric = F.col("key").rlike("^[0-9]+$")
    by_id = keys.where(numeric).join(stories.select("story_id"), F.col("key").try_cast("long") == F.col("story_id")).select("key", "story_id")
    hits = search.matches(keys.where(~numeric), items.select(F.col("item_id").alias("id"), F.col("title").alias("text")))
    matched = hits.withColumnRenamed("id", "item_id").join(items.select("item_id", "at"), "item_id").join(story_items.select("item_id", "story_id"), "item_id")
    newest = matched.groupBy("key").agg(F.max_by("story_id", F.struct("at", "item_id")).alias("story_id"))
    return by_id.unionByName(newest)


def labels(story_topics: DataFrame, spine: DataFrame, path_rows: DataFrame) -> DataFrame:
    """Each story's topic with its name, shelf and path."""
    names = spine.select(F.col("slug").alias("parent"), F.col("name").alias("parent_name"))
    described = spine.select("slug", "name", "parent").join(names, "parent", "left").join(path_rows, "slug", "left")
    return story_topics.join(described, "slug")


def stats(spine, story_topics, stories, story_items, items) -> DataFrame:
    """Per topic its stories, those nothing of which was kept, and the newest."""
    kept = story_items.join(items.where("triage_state = 'kept'").select("item_id"), "item_id", "left_semi")
    with_kept = kept.select("story_id").distinct().withColumn("has_kept", F.lit(True))
    filed = story_topics.join(stories.select("story_id", "last_activity"), "story_id").join(with_kept, "story_id", "left")
    counts = filed.groupBy("slug").agg(
        F.count("*").alias("stories"), F.count_if(F.col("has_kept").isNull()).alias("below_triage"), F.max("last_activity").alias("newest")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.select("slug", "name").join(counts, "slug", "left").select("slug", "name", zero("stories"), zero("below_triage"), "newest")


def by_source(stories, story_items, items, story_topics, path_rows, now: int, days: int) -> DataFrame:
    """Where each source's recent stories were filed, as paths of at most three steps."""
    chain = F.array_join(F.slice(F.array_append("path", F.col("slug")), 1, 3), "/")
    heads = story_topics.join(path_rows, "slug").select("story_id", chain.alias("filed"))
    recent = stories.where(F.col("last_activity") >= now - days * 86400).select("story_id")
    rows = story_items.join(recent, "story_id", "left_semi").join(items.select("item_id", "source"), "item_id")
    rows = rows.select("source", "story_id").distinct().join(heads, "story_id", "left")
    return rows.groupBy("source", F.coalesce("filed", F.lit("(none)")).alias("filed")).agg(F.count("*").alias("stories"))


def sync_spine(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """The topics table after a sync: names and parents follow the configuration."""
    want = configured.select("slug", F.col("name").alias("new_name"), F.col("parent").alias("new_parent"), F.lit(True).alias("wanted"))
    joined = stored.join(want, "slug", "full_outer")
    take = lambda new, old: F.when(F.col("wanted"), F.col(new)).otherwise(F.col(old)).alias(old)
    merged = joined.select("slug", take("new_name", "name"), take("new_parent", "parent"))
    known = merged.select(F.col("slug").alias("parent"), F.lit(True).alias("known"))
    return merged.join(known, "parent", "left").select("slug", "name", F.when(F.col("known"), F.col("parent")).alias("parent"))
