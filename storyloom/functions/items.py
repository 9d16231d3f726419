"""Columns of one item: clock, hash, metadata, engagement, text to embed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions import urls
from storyloom.functions.text import strip
from storyloom.model import METADATA

UNDATED_HOURS = 8760.0


def at() -> Column:
    return F.coalesce(F.col("published_s"), F.col("fetched_s"))


def parse_time(text: Column) -> Column:
    """ISO-8601 text as epoch seconds; without a zone it is UTC, else NULL."""
    return F.unix_seconds(F.try_to_timestamp(F.btrim(text)))


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_hours(seconds: Column, now: int) -> Column:
    """Hours since a time, never negative; undated counts as a year."""
    return F.coalesce(F.greatest((F.lit(now) - seconds) / 3600.0, F.lit(0.0)), F.lit(UNDATED_HOURS))


def day(seconds: Column) -> Column:
    return F.floor(seconds / 86400)


def in_day_window(seconds: Column, now: int, days: int) -> Column:
    """Within ``days`` of now, the whole boundary day included."""
    return day(seconds) >= (now - days * 86400) // 86400


def content_hash() -> Column:
    """Fingerprint of the fields an upstream edit changes."""
    parts = [
        F.col("kind"), F.col("url"), F.col("title"), F.col("author"), iso(F.col("published_s")),
        F.col("summary"), F.col("body"), F.col("media_url"),
    ]
    joined = F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.sha2(joined, 256)


def metadata() -> Column:
    """The metadata column parsed; text that is not JSON is an empty record."""
    return F.from_json(F.col("metadata"), METADATA, {"mode": "PERMISSIVE"})


def points(meta: Column) -> Column:
    return F.nullif(F.coalesce(meta["points"], meta["upvotes"], meta["likes"]), F.lit(0))


def comments(meta: Column) -> Column:
    return F.nullif(meta["num_comments"], F.lit(0))


def embedding_text() -> Column:
    """Title plus what identifies an item of its kind, whole: a model's window is the embedder's matter."""
    meta = metadata()
    tags = F.filter(meta["tags"], lambda t: ~F.contains(t, F.lit(":")))
    filled = lambda c: F.when(c != "", c)
    title = filled(F.col("title"))
    as_model = F.concat_ws(" ", title, filled(F.regexp_replace(meta["pipeline_tag"], "-", " ")),
                           filled(F.array_join(tags, " ")))
    as_repo = F.concat_ws(" ", title, filled(F.col("body")))
    as_thread = F.concat_ws(" ", title, filled(urls.domain(meta["outbound_url"])), filled(F.col("summary")))
    other = F.concat_ws(" ", title, filled(F.col("summary")))
    text = (
        F.when(F.col("kind") == "model", as_model).when(F.col("kind") == "repo", as_repo)
        .when(F.col("kind") == "discussion", as_thread).otherwise(other)
    )
    return strip(text)
