"""Identifiers that link items across sources, and the joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X
from storyloom.functions import urls as U

# Identifier types that name one artefact, and the fan-out guard.
STRONG = ("arxiv", "doi", "github_release", "hf_model", "url")
MAX_HOLDERS = 8
MAX_CITED = 3

# Patterns and site lists of the identifier vocabulary.
PREPRINT_URL = r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
PREPRINT_CITE = r"(?i)arxiv[:\s]\s*(\d{4}\.\d{4,5})"
DOI = r"(?i)(?<![\p{L}\p{N}_])(10\.\d{4,9}/[-._;()/:a-z0-9]+)"
HUB = r"(?i)huggingface\.co/([\p{L}\p{N}_.-]+)/([\p{L}\p{N}_.-]+)"
HUB_SECTIONS = ("datasets", "papers", "blog", "spaces", "docs", "collections", "learn")
CODE_SECTIONS = ("sponsors", "orgs", "topics", "features", "about", "pricing")
CHROME_SITES = (
    "twitter.com", "x.com", "t.co", "facebook.com", "linkedin.com", "bsky.app", "threads.net", "instagram.com", "mastodon.social", "news.ycombinator.com",
    "feedburner.com", "feeds.feedburner.com", "feedproxy.google.com", "wp.me", "gravatar.com", "doubleclick.net", "substack.com", "patreon.com",
)
CHROME_PATHS = r"(?i)/(?:share|sharer|intent|subscribe|login|signup|feed)(?:[/.?]|$)"


def pair(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def url_identifier(url: Column) -> Column:
    """The most specific identifier a URL stands for, as (type, value) or NULL."""
    section = F.lower(F.regexp_extract(url, HUB, 1))
    hub_name = U.clean_repo(F.lower(F.regexp_extract(url, HUB, 2)))
    paper = (section == "papers") & _has(hub_name, r"^\d{4}\.\d{4,5}$")
    hub = (
        F.when(paper, pair("arxiv", hub_name))
        .when(section.isin(*HUB_SECTIONS) | (hub_name == ""), F.lit(None))
        .otherwise(pair("hf_model", F.concat(section, F.lit("/"), hub_name)))
    )
    owner = F.lower(F.regexp_extract(url, U.CODE_HOST, 1))
    repo = U.clean_repo(F.lower(F.regexp_extract(url, U.CODE_HOST, 2)))
    full = F.concat(owner, F.lit("/"), repo)
    tag = F.regexp_extract(url, r"/releases/tag/([^/?#]+)", 1)
    code = (
        F.when(owner.isin(*CODE_SECTIONS) | (repo == ""), F.lit(None))
        .when(tag != "", pair("github_release", F.concat(full, F.lit("@"), tag)))
        .otherwise(pair("github_repo", full))
    )
    page = X.bind(U.canonical(url), lambda c: F.when(U.has_specific_path(c), pair("url", c)))
    return (
        F.when(_has(url, PREPRINT_URL), pair("arxiv", F.regexp_extract(url, PREPRINT_URL, 1)))
        .when(_has(url, HUB), hub)
        .when(_has(url, U.CODE_HOST), code)
        .otherwise(page)
    )


def cited(own_url: Column, links: Column) -> Column:
    """Identifiers of the pages an item links away to; a roundup yields none."""
    own = U.site(F.coalesce(own_url, F.lit("")))
    trimmed = F.transform(links, lambda v: F.btrim(v))

    def leaves(link: Column) -> Column:
        where = U.site(link)
        return (
            _has(link, "(?i)^https?://") & (where != "") & (where != own)
            & ~where.isin(*CHROME_SITES) & ~_has(link, CHROME_PATHS)
        )

    found = F.array_distinct(F.array_compact(F.transform(F.filter(trimmed, leaves), url_identifier)))
    return F.when(F.size(found) <= MAX_CITED, found)


def _all(text: Column, pattern: str, kind: str, shape=lambda v: v) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: pair(kind, shape(v)))


def _repos_named(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(U.CODE_HOST), F.lit(0))

    def one(hit: Column) -> Column:
        owner = F.lower(F.regexp_extract(hit, U.CODE_HOST, 1))
        repo = U.clean_repo(F.lower(F.regexp_extract(hit, U.CODE_HOST, 2)))
        return F.when(~owner.isin(*CODE_SECTIONS) & (repo != ""), pair("github_repo", F.concat(owner, F.lit("/"), repo)))

    return F.transform(found, one)


def extract(items: DataFrame) -> DataFrame:
    """(item_id, type, value), each once per item: metadata, addresses, links, text."""
    meta = F.col("_m")
    repo = U.repo_from(F.coalesce(meta["github_repo"], F.lit("")))
    release = F.when(
        repo.isNotNull() & (F.coalesce(meta["tag"], F.lit("")) != ""),
        pair("github_release", F.concat(repo, F.lit("@"), meta["tag"])),
    )
    structured = F.array(
        F.when(meta["arxiv_id"] != "", pair("arxiv", U.strip_version(meta["arxiv_id"]))),
        F.when(meta["hf_id"] != "", pair("hf_model", F.lower(meta["hf_id"]))),
        F.when(repo.isNotNull(), pair("github_repo", repo)),
        release,
        url_identifier(F.col("url")),
        F.when(meta["outbound_url"] != "", url_identifier(meta["outbound_url"])),
    )
    empty = F.array().cast("array<struct<type:string,value:string>>")
    text = F.col("_text")
    everything = F.concat(
        structured,
        F.coalesce(cited(F.col("url"), meta["links"]), empty),
        _all(text, PREPRINT_URL, "arxiv"),
        _all(text, PREPRINT_CITE, "arxiv"),
        _all(text, DOI, "doi", lambda v: F.regexp_replace(F.lower(v), r"\.+$", "")),
        _repos_named(text),
    )
    # Metadata is parsed and text joined once, in a projection of their own, and
    # the outer explode keeps the optimizer from testing the array (and so
    # computing it again) in a filter below.
    ready = items.select("item_id", "url", I.metadata().alias("_m"), F.concat_ws(" ", "title", "summary", "body").alias("_text"))
    found = ready.select("item_id", F.array_distinct(F.array_compact(everything)).alias("found"))
    each = found.select("item_id", F.explode_outer("found").alias("f"))
    return each.where("f IS NOT NULL").select("item_id", "f.type", "f.value")


def pending(items: DataFrame, identifiers: DataFrame, enriched: DataFrame) -> DataFrame:
    """Items never scanned: no identifier and no marker."""
    return items.join(identifiers.select("item_id"), "item_id", "left_anti").join(
        enriched.select("item_id"), "item_id", "left_anti"
    )


def shared(identifiers: DataFrame) -> DataFrame:
    """Strong identifiers two to eight items hold: the exact joins there are."""
    # One row per item, type and value already, so counting rows counts items.
    counts = identifiers.where(F.col("type").isin(*STRONG)).groupBy("type", "value").agg(F.count("*").alias("items"))
    return counts.where(F.col("items").between(2, MAX_HOLDERS))


def generic(identifiers: DataFrame) -> DataFrame:
    """Identifiers so widely held that they describe a category."""
    counts = identifiers.groupBy("type", "value").agg(F.count("*").alias("holders"))
    return counts.where(F.col("holders") > MAX_HOLDERS)


def earliest_sharing(identifiers: DataFrame, order: DataFrame) -> DataFrame:
    """Per item the earliest other item sharing a strong, non-generic identifier.

    ``order`` holds (item_id, ord) of the items that can be in a story. Each
    identifier is reduced to its earliest holder by a partial aggregate, so no
    pairs of holders are formed; the holders of over-shared identifiers drop
    out against the small aggregate side.
    """
    strong = identifiers.where(F.col("type").isin(*STRONG))
    usable = strong.groupBy("type", "value").agg(F.count("*").alias("holders")).where(
        F.col("holders").between(2, MAX_HOLDERS)
    )
    held = strong.join(usable, ["type", "value"]).join(order, "item_id")
    first = held.groupBy("type", "value").agg(F.min(F.struct("ord", "item_id")).alias("first"))
    reached = held.join(first, ["type", "value"]).where(F.col("first.ord") < F.col("ord"))
    return reached.groupBy("item_id").agg(F.min("first").alias("first")).select(
        "item_id", F.col("first.item_id").alias("parent")
    )
