"""The one shape every normaliser produces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.model import ITEM_KINDS

COLUMNS = ("external_id", "kind", "url", "title", "author", "published_s", "summary", "body", "media_url", "metadata")


def raw_item(external_id: Column, kind: str, url: Column, title: Column, *, author: Column | None = None, published_s: Column | None = None,
             summary: Column | None = None, body: Column | None = None, media_url: Column | None = None, metadata: Column | None = None) -> list[Column]:
    """The columns of a fetched item before triage; ``metadata`` is a struct."""
    if kind not in ITEM_KINDS:
        raise ValueError(f"unknown item kind: {kind!r}")
    text = F.lit(None).cast("string")
    return [
        external_id.alias("external_id"), F.lit(kind).alias("kind"), url.alias("url"), title.alias("title"),
        (text if author is None else author).alias("author"),
        (F.lit(None).cast("long") if published_s is None else published_s).alias("published_s"),
        (text if summary is None else summary).alias("summary"), (text if body is None else body).alias("body"),
        (text if media_url is None else media_url).alias("media_url"),
        (text if metadata is None else F.to_json(metadata)).alias("metadata"),
    ]


def filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""
