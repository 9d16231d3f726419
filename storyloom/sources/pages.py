"""What a web page says about itself: head metadata, title, description, picture, feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.functions import urls as U

# Metadata keys by purpose, best first, and pictures that show no page.
TITLE_KEYS = ("og:title", "twitter:title")
DESCRIPTION_KEYS = ("og:description", "twitter:description", "description")
IMAGE_KEYS = ("og:image", "og:image:url", "twitter:image", "twitter:image:src")
SITE_KEY = "og:site_name"
NOT_ART = ("arxiv.org/static/browse/", "opengraph.githubassets.com/")
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json")
SEPARATORS = r" |\\\-–—·:"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted either way or bare; NULL when it is empty or absent."""
    pattern = rf"""(?i)(?<![\w:.-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    values = [F.regexp_extract(tag, pattern, n) for n in (1, 2, 3)]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def head_meta(html: Column) -> Column:
    """Map of the head's metadata; the first of each key wins."""
    head = F.split(html, r"(?i)</head\s*>", 2)[0]
    tags = F.regexp_extract_all(head, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    pairs = F.transform(tags, lambda t: F.struct(
        F.lower(F.coalesce(_attribute(t, "property"), _attribute(t, "name"))).alias("key"), _attribute(t, "content").alias("value")))
    usable = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    keys = F.array_distinct(F.transform(usable, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.get(F.filter(usable, lambda p: p["key"] == k), F.lit(0))))


def title(html: Column, meta: Column) -> Column:
    """The announced title, else the page's title without its site's name."""
    announced = F.coalesce(*[X.strip_html(F.element_at(meta, k)) for k in TITLE_KEYS])
    own = X.strip_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))
    site = X.strip_html(F.element_at(meta, SITE_KEY))
    cut = F.regexp_replace(F.left(own, F.length(own) - F.length(site)), f"[{SEPARATORS}]+$", "")
    own = F.when(site.isNotNull() & F.endswith(own, site) & (own != site) & (cut != ""), cut).otherwise(own)
    return F.coalesce(announced, own)


def description(meta: Column) -> Column:
    """The page's own description: written on purpose, or nothing."""
    texts = [X.strip_html(F.element_at(meta, k)) for k in DESCRIPTION_KEYS]
    return F.coalesce(*[F.when(F.length(t) >= X.WRITTEN_MINIMUM, t) for t in texts])


def image(meta: Column, base: Column) -> Column:
    """The page's picture, resolved; only http(s), and never a site's own logo."""
    raws = F.array(*[F.coalesce(X.strip_html(F.element_at(meta, key)), F.btrim(F.element_at(meta, key))) for key in IMAGE_KEYS])
    full = F.transform(F.filter(raws, lambda r: F.coalesce(r, F.lit("")) != ""), lambda r: U.resolve(base, r))
    not_art = F.lit("(?i)" + "|".join(m.replace(".", r"\.") for m in NOT_ART))
    usable = F.filter(full, lambda u: F.regexp_like(u, F.lit("(?i)^https?://")) & ~F.regexp_like(u, not_art))
    return F.get(usable, F.lit(0))


def announced_feeds(html: Column, base: Column) -> Column:
    """Addresses of the feeds a page links to, in order, each once."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))

    def feed(tag: Column) -> Column:
        rels = F.split(F.lower(_attribute(tag, "rel")), r"\s+")
        is_feed = F.array_contains(rels, F.lit("alternate")) & F.lower(_attribute(tag, "type")).isin(*FEED_TYPES)
        return F.when(is_feed, _attribute(tag, "href"))

    written = X.decode_each(F.array_compact(F.transform(tags, feed)))
    return F.array_distinct(F.transform(written, lambda href: U.resolve(base, href)))
