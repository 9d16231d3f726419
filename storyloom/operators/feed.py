"""Ranking stories and showing them: scores, feeds, cards, renewal, retention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import vectors as V

HALF_LIFE_HOURS = 48.0
SOURCE_BONUS, ROLE_BONUS, MAX_CORROBORATION = 0.12, 0.08, 1.25
SOURCE_DECAY, KIND_DECAY = 0.55, 0.80

# Which item speaks for a story, best first.
KIND_ORDER = ("paper", "model", "repo", "video", "article", "post", "discussion")
ROLE_ORDER = ("seed", "paper", "code", "video", "coverage", "discussion")


def lift(gap_hours: Column) -> Column:
    return F.pow(F.lit(2.0), gap_hours / HALF_LIFE_HOURS)


def bars(value: Column) -> Column:
    return F.when(value >= 2, 3).when(value >= 1.5, 2).otherwise(1)


def score(relevance: Column, age_hours: Column, sources: Column, roles: Column) -> Column:
    """Relevance halved every two days, raised a little by corroboration."""
    recency = F.pow(F.lit(2.0), -age_hours / HALF_LIFE_HOURS)
    more = lambda c: F.greatest(c - 1, F.lit(0))
    corroboration = F.least(1.0 + SOURCE_BONUS * more(sources) + ROLE_BONUS * more(roles), F.lit(MAX_CORROBORATION))
    return F.coalesce(relevance, F.lit(0.0)) * recency * corroboration


def _place(value: Column, order: tuple[str, ...]) -> Column:
    ranks = F.array_position(F.array(*[F.lit(o) for o in order]), value).cast("int")
    return F.when(ranks > 0, ranks - 1).otherwise(F.lit(len(order)))


def lead_rank() -> Column:
    return F.struct(
        _place(F.col("kind"), KIND_ORDER).alias("kind"), _place(F.col("role"), ROLE_ORDER).alias("role"),
        (-F.coalesce("triage_score", F.lit(0.0))).alias("score"), F.col("item_id").alias("id"),
    )


def window(stories: DataFrame, now: int, days: int | None, interactions: DataFrame | None = None) -> DataFrame:
    """Stories of the last days (boundary day included), optionally only unseen ones."""
    chosen = stories if days is None else stories.where(I.in_day_window(F.col("last_activity"), now, days))
    if interactions is not None:
        seen = interactions.where("action = 'seen'").select("story_id")
        chosen = chosen.join(seen, "story_id", "left_anti")
    return chosen


def aggregates(stories: DataFrame, story_items: DataFrame, items: DataFrame) -> DataFrame:
    """What both orderings need of each story.

    Counted per (story, source) first, so a story holding very many items is
    spread over its sources and over map-side sums before it meets in one row;
    the few roles travel as bits.
    """
    narrow = items.select("item_id", "source", "triage_score", "at")
    rows = story_items.join(stories.select("story_id"), "story_id", "left_semi").join(narrow, "item_id")
    bit = F.shiftleft(F.lit(1), 0)
    for n, name in enumerate(ROLE_ORDER):
        bit = F.when(F.col("role") == name, F.lit(2 << n)).otherwise(bit)
    per_source = rows.groupBy("story_id", "source").agg(
        F.max("triage_score").alias("relevance"), F.count("*").alias("items"), F.bit_or(bit).alias("roles"),
        F.max("at").alias("newest"), F.min("at").alias("origin"),
    )
    return per_source.groupBy("story_id").agg(
        F.max("relevance").alias("relevance"), F.sum("items").alias("item_count"), F.count("*").alias("source_count"),
        F.bit_count(F.bit_or("roles")).cast("long").alias("role_count"), F.max("newest").alias("newest"), F.min("origin").alias("origin"),
    )


def scored(story_rows: DataFrame, now: int, age_from: str = "newest") -> DataFrame:
    hours = I.age_hours(F.col(age_from), now)
    return story_rows.withColumn("score", score(F.col("relevance"), hours, F.col("source_count"), F.col("role_count")))


def ranked(story_rows: DataFrame, now: int, limit: int, age_from: str = "newest") -> DataFrame:
    """The ``limit`` best stories; narrow rows only, so the cut is a top-N."""
    return scored(story_rows, now, age_from).orderBy(F.desc("score"), "story_id").limit(limit)


def recent(story_rows: DataFrame, now: int, limit: int = 0) -> DataFrame:
    """Newest first; 0 takes every story. The score travels along."""
    ordered = scored(story_rows, now).orderBy(F.desc("newest"), "story_id")
    return ordered.limit(limit) if limit else ordered


def pool_size(limit: int) -> int:
    return max(limit * 6, 60)


def cards(chosen: DataFrame, stories: DataFrame, story_items: DataFrame, items: DataFrame, interactions: DataFrame) -> DataFrame:
    """One card per chosen story, from one aggregate over its members."""
    members = story_items.join(chosen.select("story_id"), "story_id", "left_semi").join(
        items.select("item_id", "title", "summary", "url", "kind", "source", "media_url", "published_s", "triage_score"), "item_id")
    rank = lead_rank()
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    roles = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLE_ORDER]
    made = members.groupBy("story_id").agg(
        F.min_by(F.struct("title", "url", "kind", "source", "published_s"), rank).alias("lead"),
        F.min_by("summary", F.when(has("summary"), rank)).alias("best_summary"),
        F.min_by("media_url", F.when(has("media_url"), F.col("item_id"))).alias("media_url"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("item_count"), *roles,
    )
    seen = interactions.where("action = 'seen'").select("story_id").distinct().withColumn("was_seen", F.lit(True))
    texts = stories.select("story_id", F.col("title").alias("own_title"), F.col("summary").alias("own_summary"))
    full = made.join(texts, "story_id").join(seen, "story_id", "left")
    return full.select(
        "story_id", F.coalesce("own_title", "lead.title").alias("title"), F.coalesce("own_summary", "best_summary").alias("summary"),
        "lead.url", "lead.kind", "lead.source", "lead.published_s", "media_url", "sources", "item_count",
        *[f"n_{r}" for r in ROLE_ORDER], F.coalesce("was_seen", F.lit(False)).alias("seen"),
    )


def diversify(pool: DataFrame, limit: int, key: str | None = None) -> DataFrame:
    """Greedy pick of each feed's pool, a repeated source or kind counting less.

    A pool holds at most ``pool_size(limit)`` cards per feed, whatever the
    corpus holds, so one group is small.
    """
    fields = "feed string, place int, story_id long, source string, kind string, score double, damped double"

    def pick(cards: pd.DataFrame) -> pd.DataFrame:
        left = cards.sort_values(["score", "story_id"], ascending=[False, True]).reset_index(drop=True)
        sources = {s: 0 for s in left["source"]}
        kinds = {k: 0 for k in left["kind"]}
        taken = []
        while len(left) and len(taken) < limit:
            damp = left["source"].map(sources).rpow(SOURCE_DECAY) * left["kind"].map(kinds).rpow(KIND_DECAY)
            value = left["score"] * damp
            best = value.idxmax()
            row = left.loc[best]
            taken.append((row["feed"], len(taken) + 1, row["story_id"], row["source"], row["kind"], row["score"], value[best]))
            sources[row["source"]] += 1
            kinds[row["kind"]] += 1
            left = left.drop(index=best)
        return pd.DataFrame(taken, columns=["feed", "place", "story_id", "source", "kind", "score", "damped"])

    feed = F.col(key).cast("string") if key else F.lit("all")
    return pool.select(feed.alias("feed"), "story_id", "source", "kind", "score").groupBy("feed").applyInPandas(pick, fields)


def detail(story_items: DataFrame, items: DataFrame) -> DataFrame:
    """Members of stories in reading order: undated first, then by date."""
    rows = story_items.join(items.select("item_id", "title", "url", "kind", "source", "author", "published_s"), "item_id")
    return rows.orderBy("story_id", F.asc_nulls_first("published_s"), "item_id")


def mark_seen(interactions: DataFrame, shown: DataFrame, reader: int, at: int) -> DataFrame:
    """The interactions with a ``seen`` row for each story shown."""
    marks = shown.select(
        F.lit(None).cast("long").alias("event_id"), F.lit(reader).cast("long").alias("reader"), "story_id",
        F.lit("seen").alias("action"), F.timestamp_seconds(F.lit(at)).alias("at"),
    )
    return interactions.unionByName(marks)


def ends(story_items: DataFrame, items: DataFrame) -> DataFrame:
    """The oldest and the newest member of each story."""
    rows = story_items.join(items.select("item_id", "kind", "source", "at"), "item_id")
    who, when = F.struct("role", "kind", "source", "at"), F.struct("at", "item_id")
    return rows.groupBy("story_id").agg(F.min_by(who, when).alias("oldest"), F.max_by(who, when).alias("newest"))


def renewal(story_rows: DataFrame, story_items: DataFrame, items: DataFrame, now: int, limit: int) -> DataFrame:
    """What late arrivals changed in the feed: each card's gap, lift and move."""
    deep_limit = max(limit * 3, 60)
    # Both lists are cut to their length before they are numbered.
    numbered = lambda df, name: df.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), "story_id")))
    live = numbered(ranked(story_rows, now, limit), "position").select("story_id", "position")
    deep = numbered(ranked(story_rows, now, deep_limit, "origin"), "origin_position").select("story_id", "origin_position")
    members = story_items.join(live.select("story_id"), "story_id", "left_semi")
    rows = live.join(deep, "story_id", "left").join(ends(members, items), "story_id")
    gap = F.greatest(I.age_hours(F.col("oldest.at"), now) - I.age_hours(F.col("newest.at"), now), F.lit(0.0))
    return rows.withColumn("gap_hours", gap).select(
        "story_id", "position", "origin_position", (F.col("origin_position") - F.col("position")).alias("moved"), "gap_hours",
        lift(F.col("gap_hours")).alias("lift"), F.col("newest.role").alias("renewed_role"),
        F.coalesce(F.col("origin_position") > limit, F.lit(True)).alias("carried"),
    )


def renewal_summary(rows: DataFrame) -> DataFrame:
    renewed = F.col("gap_hours") >= 1.0
    return rows.agg(
        F.count("*").alias("stories"), F.count_if(renewed).alias("renewed"), F.count_if(F.col("carried")).alias("carried"),
        F.coalesce(F.percentile(F.when(renewed, F.col("gap_hours")), F.lit(0.5)), F.lit(0.0)).alias("median_gap"),
    )


def within_retention(story_rows: DataFrame, homes: DataFrame, settings: DataFrame, now: int, default_days: int | None) -> DataFrame:
    """Stories no older than their home topic keeps them."""
    rows = story_rows.join(homes.select("story_id", "slug"), "story_id", "left").join(settings.select("slug", "keep_days", "keep_most"), "slug", "left")
    days = F.coalesce("keep_days", F.lit(default_days))
    return rows.where(days.isNull() | (days == 0) | (now - F.col("newest") <= days * 86400))


def newest_per_topic(rows: DataFrame, default_most: int, largest: int) -> DataFrame:
    """The newest stories of each home topic, as many as it keeps; 0 keeps all.

    ``largest`` is the greatest cap in the settings. As a constant it lets
    Spark cut every topic to that length on the map side, so a topic holding
    most stories is never sorted whole; uncapped topics are not sorted at all.
    """
    cap = F.coalesce("keep_most", F.lit(default_most))
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("newest"), "story_id"))
    capped = rows.where(cap > 0).withColumn("place", place).where(F.col("place") <= largest).where(F.col("place") <= cap)
    return capped.drop("place").unionByName(rows.where(cap == 0))


def engagement(story_items: DataFrame, items: DataFrame) -> DataFrame:
    """The loudest member per measure."""
    meta = items.select("item_id", I.metadata().alias("m"))
    rows = story_items.select("story_id", "item_id").join(meta.select("item_id", I.points(F.col("m")).alias("points"), I.comments(F.col("m")).alias("comments")), "item_id")
    return rows.groupBy("story_id").agg(F.max("points").alias("points"), F.max("comments").alias("comments"))


def by_top(story_rows: DataFrame, homes: DataFrame, path_rows: DataFrame) -> DataFrame:
    """Stories per top-level topic."""
    top = path_rows.select("slug", F.coalesce(F.get("path", F.lit(0)), F.col("slug")).alias("top"))
    filed = homes.join(top, "slug").select("story_id", "top")
    return story_rows.select("story_id").join(filed, "story_id", "left").groupBy(F.coalesce("top", F.lit("(none)")).alias("top")).agg(F.count("*").alias("stories"))


def packed_centroids(centroids: DataFrame) -> DataFrame:
    return centroids.select("story_id", V.packed(F.col("centroid")).alias("packed"))
