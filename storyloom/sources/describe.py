"""Filling in missing descriptions and pictures from texts already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X
from storyloom.sources import pages as P
from storyloom.sources.raw import filled

STRATEGIES = ("body", "card", "repo", "page")


def steps(want_media: Column) -> Column:
    """The ways an item could be described, cheapest first, as (strategy, subject)."""
    meta = F.col("m")
    step = lambda name, subject: F.struct(F.lit(name).alias("strategy"), subject.alias("subject"))
    hub = F.coalesce(F.when(filled(meta["hf_id"]), meta["hf_id"]), F.when(filled(meta["hf_dataset"]), F.concat(F.lit("datasets/"), meta["hf_dataset"])))
    cheap = F.array_compact(F.array(
        F.when(filled(F.col("body")), step("body", F.col("body"))), F.when(hub.isNotNull(), step("card", hub)),
        F.when(filled(meta["github_repo"]), step("repo", meta["github_repo"])),
    ))
    own = filled(F.col("url")) & ((F.size(cheap) == 0) | want_media)
    page = F.when(filled(meta["outbound_url"]), step("page", meta["outbound_url"])).when(own, step("page", F.col("url")))
    return F.concat(cheap, F.array_compact(F.array(page)))


def plan(items: DataFrame, described: DataFrame, limit: int | None = None) -> DataFrame:
    """Items missing words or a picture, with the steps that could supply them, newest first when
    ``limit`` asks for so many."""
    rows = items.where(~filled(F.col("summary")) | ~filled(F.col("media_url"))).join(described.select("item_id"), "item_id", "left_anti")
    rows = rows.withColumn("m", I.metadata())
    worth = F.col("kind").isin("article", "post") | filled(F.col("m.outbound_url"))
    rows = rows.withColumn("wants_summary", ~filled(F.col("summary"))).withColumn("wants_media", ~filled(F.col("media_url")) & worth)
    rows = rows.withColumn("steps", steps(F.col("wants_media")))
    # Words are wanted from any step; a picture only comes off a page.
    rows = rows.withColumn("steps", F.filter("steps", lambda s: F.col("wants_summary") | (F.col("wants_media") & (s["strategy"] == "page"))))
    rows = rows.where(F.size("steps") > 0).select("item_id", "at", "steps", "wants_summary", "wants_media")
    return rows.orderBy(F.desc("at"), "item_id").limit(limit) if limit else rows


def apply(items: DataFrame, planned: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after describing, and the markers of all that were tried.

    ``fetched`` holds (strategy, subject, text): card and page text, and repo
    blurbs. The first step that yields words gives the summary, the first that
    yields a picture the picture. New words re-open an item; a picture does not.
    """
    each = planned.select("item_id", "wants_summary", "wants_media", F.posexplode("steps").alias("place", "s")).select(
        "item_id", "wants_summary", "wants_media", "place", "s.strategy", "s.subject")
    own = each.where("strategy = 'body'").withColumn("text", F.col("subject"))
    other = each.where("strategy <> 'body'").join(fetched, ["strategy", "subject"], "left").select(*own.columns)
    rows = own.unionByName(other).withColumn("meta", F.when(F.col("strategy") == "page", P.head_meta(F.col("text"))))
    blurb = X.strip_html(F.when(F.col("strategy") == "repo", F.col("text")))
    words = (
        F.when(F.col("strategy").isin("body", "card"), X.prose_summary(F.when(F.col("strategy").isin("body", "card"), F.col("text"))))
        .when(F.col("strategy") == "repo", F.when(F.length(blurb) >= X.WRITTEN_MINIMUM, blurb))
        .otherwise(P.description(F.col("meta")))
    )
    rows = rows.withColumn("words", words).withColumn("art", P.image(F.col("meta"), F.col("subject")))
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    found = rows.groupBy("item_id").agg(
        F.first("wants_summary").alias("wants_summary"), F.first("wants_media").alias("wants_media"), pick("words").alias("words"), pick("art").alias("art"))
    joined = items.join(found, "item_id", "left")
    new_words = F.coalesce(F.col("wants_summary") & F.col("words").isNotNull(), F.lit(False))
    new_art = F.coalesce(F.col("wants_media") & F.col("art").isNotNull(), F.lit(False))
    after = joined.select(
        *[c for c in items.columns if c not in ("summary", "media_url", "triage_state", "triage_score", "embedded_hash")],
        F.when(new_words, F.col("words")).otherwise(F.col("summary")).alias("summary"),
        F.when(new_art, F.col("art")).otherwise(F.col("media_url")).alias("media_url"),
        F.when(new_words, F.lit(None)).otherwise(F.col("embedded_hash")).alias("embedded_hash"),
        F.when(new_words, F.lit("pending")).otherwise(F.col("triage_state")).alias("triage_state"),
        F.when(new_words, F.lit(None)).otherwise(F.col("triage_score")).alias("triage_score"),
    )
    return after, planned.select("item_id")
