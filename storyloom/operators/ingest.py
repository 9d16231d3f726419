"""Ingest, retention and health of the item store."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import items as I

MAX_ITEM_AGE_DAYS = 60
IDENTITY = ["source", "external_id"]
CONTENT = ["kind", "url", "title", "author", "published_s", "summary", "body", "media_url", "metadata"]


def last_delivery(batch: DataFrame) -> DataFrame:
    """One row per identity, the last delivered; a partial aggregate, so a key
    delivered very often stays cheap."""
    rest = [c for c in batch.columns if c not in IDENTITY]
    return batch.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r")).select(*IDENTITY, "r.*")


def classify(batch: DataFrame, stored: DataFrame, now: int, max_age_days: int = MAX_ITEM_AGE_DAYS) -> DataFrame:
    """Each delivered item as inserted, updated, unchanged or stale.

    Only an unseen item can be stale; an undated one never is.
    """
    known = stored.select(*IDENTITY, F.col("content_hash").alias("stored_hash"), F.lit(True).alias("known"))
    fresh = last_delivery(batch).withColumn("content_hash", I.content_hash())
    unseen = F.col("known").isNull()
    stale = F.coalesce(F.col("published_s") < now - max_age_days * 86400, F.lit(False))
    outcome = (
        F.when(unseen & stale, "stale").when(unseen, "inserted")
        .when(F.col("stored_hash").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")
    )
    return fresh.join(known, IDENTITY, "left").withColumn("outcome", outcome).drop("known", "stored_hash")


def upsert(stored: DataFrame, classified: DataFrame) -> DataFrame:
    """The store after a batch: content replaced or added, verdicts untouched."""
    content = [*CONTENT, "content_hash"]
    new = classified.where(F.col("outcome").isin("inserted", "updated")).select(
        *IDENTITY, F.struct(*content).alias("new")
    )
    joined = stored.join(new, IDENTITY, "full_outer")
    taken = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in content]
    return joined.select(
        *IDENTITY, *taken,
        F.coalesce("triage_state", F.lit("pending")).alias("triage_state"), "triage_score", "embedded_hash",
    )


def totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy("source").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "unchanged", "stale")]
    )


def sync_sources(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Configuration decides its own sources; others keep their state."""
    want = configured.select("kind", "name", F.struct("url", "enabled").alias("want"))
    joined = stored.join(want, ["kind", "name"], "full_outer")
    wanted = F.col("want").isNotNull()
    dropped = (F.col("origin") == "config") & ~wanted
    return joined.select(
        "kind", "name",
        F.when(wanted, F.col("want.url")).otherwise(F.col("url")).alias("url"),
        F.when(wanted, F.col("want.enabled")).when(dropped, F.lit(False)).otherwise(F.col("enabled")).alias("enabled"),
        F.coalesce("origin", F.lit("config")).alias("origin"),
    )


def fetch_outcomes(outcomes: DataFrame) -> DataFrame:
    """Per source: the last attempt, its error, and the state of the last success."""
    when = F.struct("at_s", "seq")
    return outcomes.groupBy("source").agg(
        F.max("at_s").alias("last_fetched_s"),
        F.max_by("error", when).alias("last_error"),
        F.max_by(F.when(F.col("error").isNotNull(), F.col("at_s")), when).alias("last_error_s"),
        F.max_by("state", F.when(F.col("error").isNull(), when)).alias("state"),
    )


def recent(items: DataFrame, sources: DataFrame, limit: int = 50, state: str | None = None) -> DataFrame:
    """Newest items with their source. The cut comes before the join: every
    item has a source, so the join keeps the rows it is given."""
    chosen = items if state is None else items.where(F.col("triage_state") == state)
    top = chosen.orderBy(F.col("at").desc(), F.col("item_id")).limit(limit)
    return top.join(sources.select(F.col("name").alias("source"), F.col("kind").alias("source_kind")), "source")


def source_health(items: DataFrame, sources: DataFrame) -> DataFrame:
    counts = items.groupBy("source").agg(F.count("*").alias("n"), F.max("at").alias("newest"))
    return sources.join(counts, sources["name"] == counts["source"], "left").select(
        "kind", "name", "enabled", "last_error", F.coalesce("n", F.lit(0)).alias("item_count"), "newest"
    )


def broken(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("enabled") & F.col("last_error").isNotNull()).select("name", "last_error")


def doomed(items: DataFrame, story_items: DataFrame, interactions: DataFrame, now: int, days: int) -> DataFrame:
    """Items past retention, except those in a story somebody saved."""
    old = items.where(I.day(F.col("at")) < (now - days * 86400) // 86400)
    saved = interactions.where(F.col("action") == "saved").select("story_id").distinct()
    exempt = story_items.join(saved, "story_id", "left_semi").select("item_id")
    return old.join(exempt, "item_id", "left_anti")


def prune(items, vectors, story_items, stories, interactions, now: int, days: int) -> dict[str, DataFrame]:
    """The four tables after retention; vectors and stories follow their items."""
    gone = doomed(items, story_items, interactions, now, days).select("item_id")
    kept = items.join(gone, "item_id", "left_anti")
    members = story_items.join(gone, "item_id", "left_anti")
    return {
        "items": kept,
        "vectors": vectors.join(kept.select("item_id"), "item_id", "left_semi"),
        "story_items": members,
        "stories": stories.join(members.select("story_id"), "story_id", "left_semi"),
    }


def reconcile(sources: DataFrame, used: DataFrame) -> DataFrame:
    """A reader's source is enabled exactly while some topic takes it."""
    marks = used.select(F.col("source").alias("name")).distinct().withColumn("used", F.lit(True))
    enabled = F.when(F.col("origin") == "reader", F.coalesce("used", F.lit(False))).otherwise(F.col("enabled"))
    return sources.join(marks, "name", "left").select("name", "origin", enabled.alias("enabled"))


def status(items, stories, story_topics, sources) -> DataFrame:
    """Counts by state, stories, labelled stories, newest item, failing sources.

    Each part is one global aggregate; the parts meet as labelled rows, not
    through a join.
    """
    parts = items.agg(
        *[F.count_if(F.col("triage_state") == s).alias(s) for s in ("kept", "rejected", "pending")],
        F.max("at").alias("newest_item"),
    )
    parts = parts.select(F.explode(F.create_map(
        F.lit("kept"), "kept", F.lit("rejected"), "rejected", F.lit("pending"), "pending",
        F.lit("newest_item"), "newest_item")).alias("measure", "value"))
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
    return (
        parts.unionByName(one(stories, "stories"))
        .unionByName(one(story_topics.select("story_id").distinct(), "labelled"))
        .unionByName(one(broken(sources), "failing_sources"))
        .unionByName(sources.agg(F.max("last_fetched_s").alias("value")).select(F.lit("last_fetch").alias("measure"), "value"))
    )


def fingerprint(settings: dict) -> str:
    """Identity of a configuration: its canonical JSON, hashed, 16 characters."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def reopen_changed(items: DataFrame, current: str) -> DataFrame:
    """Verdicts given under another configuration go back to pending."""
    same = F.col("fingerprint").eqNullSafe(F.lit(current))
    keep = lambda c, other: F.when(same, F.col(c)).otherwise(other)
    return items.select(
        "item_id", keep("triage_state", F.lit("pending")).alias("triage_state"),
        keep("triage_score", F.lit(None).cast("double")).alias("triage_score"), F.lit(current).alias("fingerprint"),
    )
