"""Normalisers, page metadata and describing, over payloads made from the tables.

A payload is what a service would have answered: the entries of twenty
consecutive documents (or pages) in that service's own format.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X
from storyloom.model import NOW, mapped, relation, spread_relation, table
from storyloom.plans.registry import query
from storyloom.plans.scalars import FLAT, JSON, js
from storyloom.session import spread
from storyloom.sources import apis, feeds, normalise, sitemaps
from storyloom.sources import describe as D
from storyloom.sources import pages as P
from storyloom.sources.raw import COLUMNS

CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def clean(c):
    return F.regexp_replace(c, CONTROL, "")


def esc(c):
    """Text made safe inside XML."""
    out = clean(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def tag(name, value):
    """An XML element, or nothing for NULL."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))


def wide(spark, sf, text, key):
    """A mapping on every core: its text is worked on at length."""
    return spread(mapped(spark, sf, text), key, len(table(spark, sf, "documents").inputFiles()))


def payloads(rows, key: str, part: str, before: str, after: str):
    """Twenty rows' parts joined into one body."""
    block = F.floor(F.col(key) / 20).alias("block")
    body = F.concat(F.lit(before), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, part))), lambda p: p[part]), ""), F.lit(after))
    return rows.groupBy(block).agg(body.alias("body"))


ENTRY = """SELECT i.item_id, i.title, i.url, CASE WHEN i.item_id % 3 <> 0 THEN i.external_id END AS guid, i.author, i.published_s,
  '<p>' || coalesce(i.summary, '') || '</p> <a href="https://ref.example.org/' || CAST(i.item_id AS STRING) || '">more</a> <a href="https://ref.example.org/' || CAST(i.item_id AS STRING) || '">more</a>' AS description,
  i.media_url, i.item_id % 4 AS art FROM items i"""


def rss_payloads(spark, sf):
    e = wide(spark, sf, ENTRY, "item_id")
    when = F.date_format(F.timestamp_seconds("published_s"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    pic = F.concat(F.lit("https://pic.example.net/"), F.col("item_id").cast("string"), F.lit(".png"))
    art = (
        F.when(F.col("art") == 0, F.concat(F.lit('<media:content url="'), "media_url", F.lit('"/>')))
        .when(F.col("art") == 1, F.concat(F.lit('<media:thumbnail url="'), pic, F.lit('"/>')))
        .when(F.col("art") == 2, F.concat(F.lit('<enclosure url="'), pic, F.lit('" type="image/png"/>')))
        .otherwise(F.concat(F.lit('<enclosure url="'), pic, F.lit('" type="audio/mpeg"/>')))
    )
    part = F.concat(F.lit("<item>"), tag("title", esc(F.col("title"))), tag("link", esc(F.col("url"))), tag("guid", F.col("guid")), tag("author", F.col("author")),
                    tag("description", esc(F.col("description"))), tag("pubDate", when), art, F.lit("</item>"))
    rows = e.select("item_id", part.alias("part"))
    body = payloads(rows, "item_id", "part", '<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>t</title>', "</channel></rss>")
    return body.select(F.lit("https://feed.example.org/rss").alias("feed"), "body")


@query("a01_feed_entries", f"""
SELECT coalesce(guid, url) AS external_id, 'article' AS kind, url, {FLAT.format('title')} AS title, author, published_s, {FLAT.format('description')} AS summary,
  CAST(NULL AS VARCHAR) AS body, CASE art WHEN 0 THEN media_url WHEN 1 THEN 'https://pic.example.net/' || item_id || '.png' WHEN 2 THEN 'https://pic.example.net/' || item_id || '.png' END AS media_url,
  '{{"feed":"https://feed.example.org/rss","links":["https://ref.example.org/' || item_id || '"]}}' AS metadata FROM (SELECT item_id, regexp_replace(title, '{CONTROL}', '', 'g') AS title, url, guid, author, published_s, regexp_replace(description, '{CONTROL}', '', 'g') AS description, media_url, art FROM entry) e""", {"entry": ENTRY})
def feed_entries(spark, sf):
    return normalise("rss", rss_payloads(spark, sf))


BROKEN = "SELECT i.item_id, i.url, i.source, i.published_s, i.item_id % 5 AS shape FROM items i"


def broken_payloads(spark, sf):
    """Feeds that are no XML as a whole: bare ampersands, open markup, a tag that breaks off, an end that is missing."""
    e = wide(spark, sf, BROKEN, "item_id")
    number = F.col("item_id").cast("string")
    at = lambda text: F.concat(F.lit(text), number)
    eastern = F.concat(F.date_format(F.timestamp_seconds(F.col("published_s") - 5 * 3600), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" EST"))
    part = (
        F.when(F.col("shape") == 0, F.concat(F.lit('<item rdf:about="urn:'), number, F.lit('">'), tag("title", F.concat(at("Q&A "), F.lit(" at AT&T"))), tag("link", F.col("url")),
                                             tag("dc:creator", F.col("source")), tag("dc:date", I.iso(F.col("published_s"))),
                                             F.lit("<content:encoded><![CDATA[<p>whole &amp; long</p>]]></content:encoded></item>")))
        .when(F.col("shape") == 1, F.concat(F.lit("<item>"), tag("title", at("open ")), tag("link", F.col("url")), F.lit("<description>one <b>two</description></item>")))
        .when(F.col("shape") == 2, F.concat(F.lit("<item>"), tag("title", at("no link ")), F.lit("</item>")))
        .when(F.col("shape") == 3, F.concat(F.lit("<item <title>"), number, F.lit("</title></item>")))
        .otherwise(F.concat(F.lit("<item>"), tag("title", at("zone ")), tag("link", F.col("url")), F.lit('<guid isPermaLink="false">g'), number, F.lit("</guid>"), tag("pubDate", eastern), F.lit("</item>")))
    )
    body = payloads(e.select("item_id", part.alias("part")), "item_id", "part", "<rdf:RDF><channel><title>R&D</title></channel>", "<item><title>cut o")
    return body.select(F.lit("https://feed.example.org/rdf").alias("feed"), "body")


@query("a01_broken_feeds", """
SELECT CASE shape WHEN 0 THEN 'urn:' || item_id WHEN 1 THEN url ELSE 'g' || item_id END AS external_id, url,
  CASE shape WHEN 0 THEN 'Q&A ' || item_id || ' at AT&T' WHEN 1 THEN 'open ' || item_id ELSE 'zone ' || item_id END AS title, CASE shape WHEN 0 THEN source END AS author,
  CASE WHEN shape <> 1 THEN published_s END AS published_s, CASE shape WHEN 0 THEN 'whole & long' WHEN 1 THEN 'one two' END AS summary FROM broken WHERE shape IN (0, 1, 4)""", {"broken": BROKEN})
def broken_feeds(spark, sf):
    return normalise("rss", broken_payloads(spark, sf)).select("external_id", "url", "title", "author", "published_s", "summary")


@query("a01_quarantined_entries", """
SELECT CASE shape WHEN 2 THEN 'no link' ELSE 'no XML' END AS reason, CASE shape WHEN 2 THEN '<item><title>no link ' || item_id || '</title>' ELSE '<item <title>' || item_id || '</title>' END AS piece
  FROM broken WHERE shape IN (2, 3) UNION ALL SELECT 'no link', '<item><title>cut o' FROM (SELECT DISTINCT floor(item_id / 20) AS block FROM broken) b""", {"broken": BROKEN})
def quarantined_entries(spark, sf):
    return feeds.quarantined(broken_payloads(spark, sf)).select("reason", "piece")


HIT = """SELECT CAST(i.item_id AS STRING) AS objectID, i.item_id, i.source, CASE WHEN i.item_id % 10 = 7 THEN NULL ELSE i.title END AS title, i.url, i.author, i.at AS created_at_i,
  CASE WHEN i.item_id % 12 = 5 THEN NULL ELSE i.n_chars % 200 END AS points, i.n_chars % 40 AS num_comments FROM items i"""


def hit_payloads(spark, sf):
    rows = mapped(spark, sf, HIT)
    hit = F.struct("objectID", "title", "url", "author", "created_at_i", "points", "num_comments")
    return rows.groupBy("source", F.floor(F.col("item_id") / 400).alias("block")).agg(F.to_json(F.struct(F.collect_list(hit).alias("hits"))).alias("body"))


@query("a02_discussion_hits", """
SELECT objectID AS external_id, 'discussion' AS kind, 'https://news.ycombinator.com/item?id=' || objectID AS url, title, author, created_at_i AS published_s,
  CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS body, CAST(NULL AS VARCHAR) AS media_url,
  '{"outbound_url":"' || url || '","points":' || coalesce(points, 0) || ',"num_comments":' || num_comments || '}' AS metadata FROM hit WHERE title <> ''""", {"hit": HIT})
def discussion_hits(spark, sf):
    return normalise("hn", hit_payloads(spark, sf))


CURSOR = f"SELECT s.name AS source, {NOW - 30 * 86400} + s.source_id * 86400 AS since FROM sources s WHERE s.source_id % 4 <> 1"


@query("a03_high_water_mark", """
SELECT s.source, coalesce(max(h.created_at_i), max(s.since)) AS since FROM (SELECT DISTINCT i.source, c.since FROM items i LEFT JOIN cur c ON c.source = i.source) s
LEFT JOIN hit h ON h.source = s.source AND h.points >= 50 AND (s.since IS NULL OR h.created_at_i > s.since) GROUP BY s.source HAVING coalesce(max(h.created_at_i), max(s.since)) IS NOT NULL""", {"hit": HIT, "cur": CURSOR})
def high_water_mark(spark, sf):
    cursors = mapped(spark, sf, CURSOR)
    fresh = apis.new_hits(apis.hits(hit_payloads(spark, sf)), cursors)
    return apis.next_cursors(fresh, cursors)


PAPER = """SELECT i.item_id, CASE WHEN i.item_id % 9 = 4 THEN 'http://example.org/x' ELSE 'http://arxiv.org/abs/2401.' || CAST(10000 + i.item_id AS STRING) || 'v' || CAST(1 + i.item_id % 3 AS STRING) END AS link,
  i.title, i.summary, i.published_s, i.item_id % 4 AS n, i.source FROM items i"""


def paper_payloads(spark, sf):
    p = mapped(spark, sf, PAPER)
    names = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat(F.lit("<author><name>A"), k.cast("string"), F.lit(" "), F.col("source"), F.lit("</name></author>")))
    names = F.when(F.col("n") > 0, F.array_join(names, "")).otherwise("")
    link = F.concat(F.lit('<link href="'), F.col("link"), F.lit('" rel="alternate" type="text/html"/><link href="http://x/pdf" rel="related" type="application/pdf"/>'))
    part = F.concat(F.lit("<entry>"), tag("id", F.col("link")), tag("title", esc(F.col("title"))), link, names, tag("summary", esc(F.col("summary"))),
                    tag("published", I.iso(F.col("published_s"))), F.lit('<category term="cs.AI"/><category term="cs.LG"/><arxiv:primary_category term="cs.AI"/></entry>'))
    return payloads(p.select("item_id", part.alias("part")), "item_id", "part", '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">', "</feed>")


@query("a04_preprint_entries", f"""
SELECT '2401.' || (10000 + item_id) AS external_id, 'paper' AS kind, 'https://arxiv.org/abs/2401.' || (10000 + item_id) AS url, {FLAT.format('title')} AS title,
  CASE n WHEN 0 THEN NULL WHEN 1 THEN 'A1 ' || source WHEN 2 THEN 'A1 ' || source || ' and A2 ' || source ELSE 'A1 ' || source || ' et al.' END AS author, published_s,
  {FLAT.format('summary')} AS summary, '2401.' || (10000 + item_id) AS arxiv_id, CAST(1 + item_id % 3 AS VARCHAR) AS version, n AS authors, 'cs.AI' AS primary_category
FROM (SELECT item_id, link, n, source, published_s, regexp_replace(title, '{CONTROL}', '', 'g') AS title, regexp_replace(summary, '{CONTROL}', '', 'g') AS summary FROM paper) p WHERE link LIKE '%arxiv%'""", {"paper": PAPER})
def preprint_entries(spark, sf):
    rows = normalise("arxiv", paper_payloads(spark, sf))
    meta = F.from_json("metadata", "arxiv_id string, version string, authors array<string>, primary_category string")
    return rows.select("external_id", "kind", "url", "title", "author", "published_s", "summary", meta.alias("m")).select(
        "external_id", "kind", "url", "title", "author", "published_s", "summary", "m.arxiv_id", "m.version",
        F.coalesce(F.size("m.authors"), F.lit(0)).cast("long").alias("authors"), "m.primary_category")


REPO = """SELECT i.item_id, CASE i.item_id % 5 WHEN 0 THEN 'run-' || substring(md5(CAST(i.item_id AS STRING)), 1, 13) WHEN 1 THEN 'solo' || CAST(i.item_id AS STRING) ELSE 'Org' || CAST(i.item_id % 6 AS STRING) || '/Model-' || CAST(i.item_id AS STRING) END AS id,
  i.author, i.published_s, i.n_chars % 300 AS likes, i.n_chars % 900 AS downloads, CASE WHEN i.item_id % 4 < 2 THEN 'arxiv:2401.' || CAST(10000 + i.item_id AS STRING) WHEN i.item_id % 4 = 2 THEN 'arxiv:' ELSE 'demo' END AS tag1, i.lang FROM items i"""
MACHINE = "regexp_matches(id, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{12,}')"
OWNER = "coalesce(author, CASE WHEN instr(id, '/') > 0 THEN split_part(id, '/', 1) END)"
LIFTED = "CASE WHEN tag1 LIKE 'arxiv:_%' THEN substring(tag1, 7) END"


def hub_payloads(spark, sf):
    rows = mapped(spark, sf, REPO)
    entry = F.struct("id", "author", I.iso(F.col("published_s")).alias("createdAt"), "likes", "downloads", F.array(F.col("lang"), F.col("tag1"), F.lit("license:mit")).alias("tags"))
    return rows.groupBy(F.floor(F.col("item_id") / 20).alias("block")).agg(F.to_json(F.collect_list(entry)).alias("body"))


def _flat(rows, fields: str, *names):
    return rows.select("external_id", "kind", "url", "title", "author", "published_s", F.from_json("metadata", fields).alias("m")).select(
        "external_id", "kind", "url", "title", "author", "published_s", *[f"m.{n}" for n in names])


@query("a05_hub_models", f"""
SELECT id AS external_id, 'model' AS kind, 'https://huggingface.co/' || id AS url, id AS title, {OWNER} AS author, published_s, id AS hf_id, {LIFTED} AS arxiv_id, likes, downloads
FROM repo WHERE NOT {MACHINE}""", {"repo": REPO})
def hub_models(spark, sf):
    return _flat(normalise("hf_models", hub_payloads(spark, sf)), "hf_id string, arxiv_id string, likes bigint, downloads bigint", "hf_id", "arxiv_id", "likes", "downloads")


@query("a06_hub_datasets", f"SELECT 'dataset:' || id AS external_id, 'model' AS kind, 'https://huggingface.co/datasets/' || id AS url, id AS title, {OWNER} AS author, published_s, id AS hf_dataset, likes FROM repo", {"repo": REPO})
def hub_datasets(spark, sf):
    return _flat(normalise("hf_datasets", hub_payloads(spark, sf)), "hf_dataset string, likes bigint", "hf_dataset", "likes")


DAILY = """SELECT i.item_id, CASE WHEN i.item_id % 3 = 0 THEN NULL ELSE i.title END AS title, i.title AS inner_title, CASE WHEN i.item_id % 4 = 0 THEN NULL ELSE i.summary END AS summary, i.media_url AS thumbnail,
  CASE WHEN i.item_id % 5 = 0 THEN NULL ELSE i.published_s END AS published_s, i.fetched_s AS inner_s, CASE WHEN i.item_id % 8 = 3 THEN NULL ELSE '2401.' || CAST(10000 + i.item_id AS STRING) END AS pid,
  i.n_chars % 33 AS upvotes, i.n_chars % 5 AS comments FROM items i"""


@query("a07_daily_papers", f"""
SELECT pid AS external_id, 'paper' AS kind, 'https://huggingface.co/papers/' || pid AS url, trim(coalesce(nullif(title, ''), inner_title)) AS title, CAST(NULL AS VARCHAR) AS author, coalesce(published_s, inner_s) AS published_s,
  coalesce(nullif(summary, ''), 'inner ' || pid) AS summary, thumbnail AS media_url, pid AS arxiv_id, upvotes, comments AS num_comments FROM daily WHERE pid <> '' AND coalesce(nullif(title, ''), inner_title) <> ''""", {"daily": DAILY})
def daily_papers(spark, sf):
    d = mapped(spark, sf, DAILY)
    paper = F.struct(F.col("pid").alias("id"), F.col("inner_title").alias("title"), F.concat(F.lit("inner "), "pid").alias("summary"), I.iso(F.col("inner_s")).alias("publishedAt"), "upvotes")
    entry = F.struct("title", "summary", "thumbnail", I.iso(F.col("published_s")).alias("publishedAt"), F.col("comments").alias("numComments"), paper.alias("paper"))
    body = d.groupBy(F.floor(F.col("item_id") / 20).alias("block")).agg(F.to_json(F.collect_list(entry)).alias("body"))
    rows = normalise("hf_papers", body)
    meta = F.from_json("metadata", "arxiv_id string, upvotes bigint, num_comments bigint")
    return rows.select("external_id", "kind", "url", "title", "author", "published_s", "summary", "media_url", meta.alias("m")).select(
        "external_id", "kind", "url", "title", "author", "published_s", "summary", "media_url", "m.*")


@query("a08_citing_paper", f"SELECT id AS external_id, {LIFTED} AS arxiv_id FROM repo WHERE NOT {MACHINE} AND {LIFTED} IS NOT NULL", {"repo": REPO})
def citing_paper(spark, sf):
    rows = apis.citing_paper(normalise("hf_models", hub_payloads(spark, sf)))
    return rows.select("external_id", F.get_json_object("metadata", "$.arxiv_id").alias("arxiv_id"))


RELEASE = """SELECT i.item_id, 'Own' || CAST(i.item_id % 5 AS STRING) || '/tool' AS repo,
  CASE i.item_id % 11 WHEN 0 THEN 'b110' || CAST(i.item_id AS STRING) WHEN 1 THEN 'v1.' || CAST(i.item_id AS STRING) || '.0' WHEN 2 THEN 'v5.15.' || CAST(i.item_id AS STRING) WHEN 3 THEN '2026.09.' || CAST(i.item_id AS STRING)
    WHEN 4 THEN '1.0rc' || CAST(i.item_id AS STRING) WHEN 5 THEN 'nightly-' || CAST(i.item_id AS STRING) WHEN 6 THEN 'core==1.6.' || CAST(i.item_id AS STRING) WHEN 7 THEN 'devel-' || CAST(i.item_id AS STRING) ELSE 'v' || CAST(i.item_id AS STRING) || '.0' END AS tag_name,
  CASE WHEN i.item_id % 2 = 0 THEN i.title END AS name, 'https://github.com/x/releases/' || CAST(i.item_id AS STRING) AS html_url, i.body, i.item_id % 13 = 0 AS draft, i.item_id % 17 = 0 AS prerelease, i.published_s, i.author FROM items i"""
PRE = r"(prerelease OR regexp_matches(tag_name, '(?i)(^|[^a-z])(alpha|beta|rc|dev|preview|snapshot|nightly)([^a-z]|$)|\d(a|b|rc)\d+$|^b\d+$'))"
VER = r"regexp_extract(tag_name, '(^|[^\d.])(\d+)\.(\d+)\.(\d+)($|[^\d])', {0})"
PATCH = f"({VER.format(2)} <> '' AND TRY_CAST({VER.format(4)} AS BIGINT) > 0 AND TRY_CAST({VER.format(2)} AS BIGINT) < 2000)"


@query("a09_releases", f"""
SELECT repo || '@' || tag_name AS external_id, 'repo' AS kind, html_url AS url, repo || ' ' || coalesce(nullif(name, ''), tag_name) AS title, author, published_s, body, repo AS github_repo, tag_name AS tag
FROM rel WHERE NOT draft AND NOT {PRE} AND NOT coalesce({PATCH}, false)""", {"rel": RELEASE})
def releases(spark, sf):
    r = mapped(spark, sf, RELEASE)
    entry = F.struct("tag_name", "name", "html_url", "body", "draft", "prerelease", I.iso(F.col("published_s")).alias("published_at"), F.struct(F.col("author").alias("login")).alias("author"))
    body = r.groupBy("repo", F.floor(F.col("item_id") / 100).alias("block")).agg(F.to_json(F.collect_list(entry)).alias("body"))
    rows = normalise("github", body)
    meta = F.from_json("metadata", "github_repo string, tag string")
    return rows.select("external_id", "kind", "url", "title", "author", "published_s", "body", meta.alias("m")).select("external_id", "kind", "url", "title", "author", "published_s", "body", "m.*")


# Sitemaps: every 25 pages are one map; a site is an index over up to 25 maps.
MAPPED = f"""SELECT page_id, CAST(floor(page_id / 25) AS BIGINT) AS map_id, CAST(floor(page_id / 625) AS BIGINT) AS site_id, url,
  CASE page_id % 4 WHEN 3 THEN NULL ELSE {NOW} - CASE WHEN floor(page_id / 625) % 2 = 1 THEN 86400 ELSE (page_id * 7) % 100 * 86400 END END AS dated_s, page_id % 4 AS form FROM @pages"""
LISTED = "SELECT 'site-' || site_id AS site, url AS loc, dated_s, CASE WHEN form = 1 THEN 'Title ' || page_id ELSE '' END AS title, page_id FROM mp"


def sitemap_payloads(spark, sf):
    m = mapped(spark, sf, MAPPED)
    date = I.iso(F.col("dated_s"))
    news = F.when(F.col("form") == 1, F.concat(F.lit("<news:news><news:publication_date>"), date, F.lit("</news:publication_date><news:title> Title "), F.col("page_id").cast("string"), F.lit(" </news:title></news:news>")))
    part = F.concat(F.lit("<url>"), tag("loc", esc(F.col("url"))), F.coalesce(news, tag("lastmod", date)), F.lit("<image:image><image:loc>http://i/x.png</image:loc></image:image></url>"))
    parts = m.withColumn("part", part).groupBy("site_id", "map_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "part"))), lambda p: p["part"]), "").alias("inner"))
    url = F.concat(F.lit("https://maps.example.org/"), F.col("map_id").cast("string"), F.lit(".xml"))
    head = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9" xmlns:image="http://i">'
    site = F.concat(F.lit("site-"), F.col("site_id").cast("string")).alias("site")
    maps = parts.select(site, url.alias("url"), F.concat(F.lit(head), "inner", F.lit("</urlset>")).alias("body"), F.lit(False).alias("is_root"))
    listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("map_id"))), lambda n: F.concat(F.lit("<sitemap><loc>https://maps.example.org/"), n.cast("string"), F.lit(".xml</loc></sitemap>"))), "")
    roots = parts.groupBy("site_id").agg(listing.alias("inner")).select(site, F.concat(F.lit("https://maps.example.org/index-"), F.col("site_id").cast("string")).alias("url"),
                                                                        F.concat(F.lit("<sitemapindex>"), "inner", F.lit("</sitemapindex>")).alias("body"), F.lit(True).alias("is_root"))
    return maps.unionByName(roots)


@query("a10_sitemap_entries", "SELECT site, loc, dated_s, CASE WHEN title = '' THEN NULL ELSE title END AS title FROM listed", {"mp": MAPPED, "listed": LISTED})
def sitemap_entries(spark, sf):
    return sitemaps.entries(sitemap_payloads(spark, sf))


INCLUDE = "/(en|fr)/"
SEEN = {"mp": MAPPED, "listed": LISTED,
        "seen": "SELECT site, loc FROM listed WHERE site <> 'site-0' AND page_id % 3 = 0",
        "wanted": f"SELECT l.*, EXISTS (SELECT 1 FROM seen s WHERE s.site = l.site) AS known FROM listed l WHERE regexp_matches(loc, '{INCLUDE}')",
        "stamped": f"SELECT site FROM wanted WHERE NOT known AND dated_s >= {NOW} - 60 * 86400 GROUP BY site HAVING count(*) >= 20 AND count(DISTINCT floor(dated_s / 86400)) <= 2",
        "candidates": f"""SELECT site, loc, dated_s FROM wanted WHERE NOT known AND dated_s >= {NOW} - 60 * 86400 AND site NOT IN (SELECT site FROM stamped)
           UNION ALL SELECT w.site, w.loc, w.dated_s FROM wanted w WHERE known AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.site = w.site AND s.loc = w.loc)"""}


@query("a11_new_urls", "SELECT site, loc, dated_s FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY dated_s DESC NULLS LAST, loc) AS rn FROM candidates) x WHERE rn <= 30", SEEN)
def new_urls(spark, sf):
    rows = sitemaps.entries(sitemap_payloads(spark, sf))
    # The site seen before had read every third page.
    read = mapped(spark, sf, MAPPED).where("page_id % 3 = 0 AND site_id <> 0")
    seen = read.select(F.concat(F.lit("site-"), F.col("site_id").cast("string")).alias("site"), F.col("url").alias("loc"))
    return sitemaps.new_urls(rows, seen, seen, INCLUDE, NOW, 30)


@query("a11_next_seen", """
SELECT DISTINCT site, loc FROM wanted w WHERE NOT known AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.site = w.site AND p.loc = w.loc AND rn > 30)
UNION SELECT site, loc FROM wanted w WHERE EXISTS (SELECT 1 FROM seen s WHERE s.site = w.site AND s.loc = w.loc)
UNION SELECT site, loc FROM picked WHERE rn <= 30""", SEEN | {"picked": "SELECT *, row_number() OVER (PARTITION BY site ORDER BY dated_s DESC NULLS LAST, loc) AS rn FROM candidates"})
def next_seen(spark, sf):
    rows = sitemaps.entries(sitemap_payloads(spark, sf))
    read = mapped(spark, sf, MAPPED).where("page_id % 3 = 0 AND site_id <> 0")
    seen = read.select(F.concat(F.lit("site-"), F.col("site_id").cast("string")).alias("site"), F.col("url").alias("loc"))
    every = sitemaps.new_urls(rows, seen, seen, INCLUDE, NOW, None)
    taken = every.where("place <= 30").select("site", "loc")
    return sitemaps.next_seen(rows, seen, seen, taken, every.where("place > 30").select("site", "loc"), INCLUDE)


@query("a12_sitemap_preview", f"""
SELECT l.site, count(*) FILTER (dated_s >= {NOW} - 7 * 86400) AS week, (SELECT string_agg(title, ' | ' ORDER BY dated_s DESC, loc) FROM (SELECT * FROM listed x WHERE x.site = l.site AND title <> '' AND dated_s IS NOT NULL ORDER BY dated_s DESC, loc LIMIT 3) t) AS latest
FROM listed l WHERE dated_s IS NOT NULL GROUP BY l.site""", {"mp": MAPPED, "listed": LISTED})
def sitemap_preview(spark, sf):
    rows = sitemaps.preview(sitemaps.entries(sitemap_payloads(spark, sf)), NOW)
    return rows.withColumn("latest", F.array_join("latest", " | "))


# Pages with the metadata publishers write: some of it, in several spellings.
HEADED = """SELECT page_id, url, replace(html, '<meta charset="utf-8">', '<meta charset="utf-8">'
  || CASE page_id % 5 WHEN 0 THEN '<meta property="og:title" content="Talk &amp; &lt;b&gt;more ' || CAST(page_id AS STRING) || '"><meta content="second" property="og:title">' WHEN 1 THEN '<META NAME=''Description'' CONTENT=''short''>' WHEN 2 THEN '<meta name="description" content="A plain description of page ' || CAST(page_id AS STRING) || ' and what is on it .">' ELSE '' END
  || CASE page_id % 3 WHEN 0 THEN '<meta property="og:image" content="/a/../img/./' || CAST(page_id AS STRING) || '.png">' WHEN 1 THEN '<meta name=twitter:image content=https://arxiv.org/static/browse/logo.png><meta property="og:image:url" content="pic.jpg">' ELSE '' END
  || CASE page_id % 4 WHEN 0 THEN '<link rel="alternate" type="application/rss+xml" href="/x/../feed/' || CAST(page_id AS STRING) || '?a=1&#38;b=2"><link type="application/atom+xml" rel="x alternate" href="https://f.example.org/a?x=1&amp;y=2"><link rel="stylesheet" href="/s.css">' WHEN 1 THEN '<link rel="alternate" type="text/html" href="/amp">' ELSE '' END) AS html FROM @pages"""
ATTR = r"""regexp_extract(t, '(?i)(^|[^\w:.-]){0}\s*=\s*("([^"]*)"|''([^'']*)''|([^\s"''>]+))', {1})"""
attr = lambda n: "coalesce(" + ", ".join(f"nullif({ATTR.format(n, g)}, '')" for g in (3, 4, 5)) + ")"
META = {
    "headed": HEADED,
    "tags": r"SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)</head\s*>.*', ''), '(?i)<meta\b[^>]*>')) AS t, generate_subscripts(regexp_extract_all(regexp_replace(html, '(?is)</head\s*>.*', ''), '(?i)<meta\b[^>]*>'), 1) AS n FROM headed",
    "meta": f"SELECT page_id, key, arg_min(value, n) AS value FROM (SELECT page_id, n, lower(coalesce({attr('property')}, {attr('name')})) AS key, {attr('content')} AS value FROM tags) x WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY page_id, key",
    "flat": "SELECT page_id, key, " + FLAT.format("replace(replace(value, '&lt;', '<'), '&gt;', '>')").replace("regexp_replace(replace(replace(value, '&lt;', '<'), '&gt;', '>'), '<[^>]+>', ' ', 'g')", "replace(replace(value, '&lt;', '<'), '&gt;', '>')") + " AS plain, value FROM meta",
}


def headed(spark, sf):
    return mapped(spark, sf, HEADED).withColumn("meta", P.head_meta(F.col("html")))


@query("a13_head_metadata", "SELECT page_id, key, value FROM meta", META)
def head_metadata(spark, sf):
    return headed(spark, sf).select("page_id", F.explode("meta").alias("key", "value"))


TITLE_TAG = r"regexp_extract(h.html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)"


@query("a14_page_title", f"SELECT h.page_id, coalesce(f.plain, {FLAT.format(TITLE_TAG)}) AS title FROM headed h LEFT JOIN flat f ON f.page_id = h.page_id AND f.key = 'og:title'", META)
def page_title(spark, sf):
    return headed(spark, sf).select("page_id", P.title(F.col("html"), F.col("meta")).alias("title"))


@query("a15_page_description", "SELECT h.page_id, CASE WHEN length(f.plain) >= 18 THEN f.plain END AS description FROM headed h LEFT JOIN flat f ON f.page_id = h.page_id AND f.key = 'description'", META)
def page_description(spark, sf):
    return headed(spark, sf).select("page_id", P.description(F.col("meta")).alias("description"))


ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query("a16_page_image", f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN {ROOT} || '/img/' || page_id || '.png' WHEN 1 THEN {ROOT} || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || 'pic.jpg' END AS image FROM headed""", META)
def page_image(spark, sf):
    return headed(spark, sf).select("page_id", P.image(F.col("meta"), F.col("url")).alias("image"))


CARD = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'license: mit' || chr(10) || '---' || chr(10) ELSE '' END || '# Title' || chr(10) || chr(10) || '![b](http://x/y.svg)' || chr(10) || chr(10)
  || CASE doc_id % 3 WHEN 0 THEN '- item one of a list that is long enough to count' ELSE 'More Information needed, says the template of the card at great length' END || chr(10) || chr(10)
  || CASE WHEN doc_id % 5 = 1 THEN '&lt;b&gt; opens a paragraph long enough to be prose &amp; kept' || chr(10) || chr(10) ELSE '' END || replace(text, chr(10), chr(10) || chr(10)) AS md FROM @documents"""
BLOCK = "trim(regexp_replace(b, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), ' ' || chr(10) || chr(9) || chr(13))"
FLATB = FLAT.format(f"replace(regexp_replace({BLOCK}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), chr(10), ' ')")


@query("a17_prose_summary", f"""
SELECT c.doc_id, replace(replace(replace(p.prose, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS summary FROM card c LEFT JOIN (
  SELECT doc_id, arg_min(prose, n) AS prose FROM (SELECT doc_id, n, {FLATB} AS prose FROM blocks WHERE NOT regexp_matches({BLOCK}, '^(#|\\||>|-|\\*|\\+|```|<|\\[!|:)') AND {BLOCK} <> '') x
   WHERE length(prose) > 40 AND NOT contains(lower(prose), 'more information needed') GROUP BY doc_id) p ON p.doc_id = c.doc_id""", {
    "card": CARD, "blocks": r"SELECT doc_id, unnest(string_split(regexp_replace(md, '(?s)^---\n.*?\n---\n', ''), chr(10) || chr(10))) AS b, generate_subscripts(string_split(regexp_replace(md, '(?s)^---\n.*?\n---\n', ''), chr(10) || chr(10)), 1) AS n FROM card"})
def prose_summary(spark, sf):
    return wide(spark, sf, CARD, "doc_id").select("doc_id", X.prose_summary(F.col("md")).alias("summary"))


WORTH = f"(kind IN ('article', 'post') OR {js('outbound_url')} <> '')"
PLAN = f"""SELECT item_id, t, ws, wm, array_to_string(list_filter([CASE WHEN body <> '' AND ws THEN 'body' END, CASE WHEN hf <> '' AND ws THEN 'card|' || hf END, CASE WHEN gh <> '' AND ws THEN 'repo|' || gh END,
   CASE WHEN (ws OR wm) AND ob <> '' THEN 'page|' || ob WHEN (ws OR wm) AND (wm OR (coalesce(body, '') = '' AND hf IS NULL AND gh IS NULL)) AND coalesce(ob, '') = '' THEN 'page|' || url END], lambda s: s IS NOT NULL), ' > ') AS steps
  FROM (SELECT item_id, i.at AS t, body, url, coalesce(summary, '') = '' AS ws, media_url IS NULL AND coalesce({WORTH}, false) AS wm, {js('hf_id')} AS hf, {js('github_repo')} AS gh, {js('outbound_url')} AS ob
     FROM items i WHERE (coalesce(summary, '') = '' OR media_url IS NULL) AND item_id NOT IN (SELECT doc_id FROM @labels WHERE quality = 0)) x"""


def planned(spark, sf, limit):
    described = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("item_id"))
    return D.plan(spread_relation(spark, sf, "items", "item_id"), described, limit)


@query("a18_describe_plan", "SELECT item_id, ws AS wants_summary, wm AS wants_media, steps FROM pl WHERE steps <> '' ", {"pl": PLAN})
def describe_plan(spark, sf):
    rows = planned(spark, sf, None)
    shown = F.transform("steps", lambda s: F.when(s["strategy"] == "body", s["strategy"]).otherwise(F.concat_ws("|", s["strategy"], s["subject"])))
    return rows.select("item_id", "wants_summary", "wants_media", F.array_join(shown, " > ").alias("steps"))


# What was fetched: a page for each item of the same number, blurbs for repositories.
BLURB = "A tool for everyone named "


def fetched(spark, sf):
    items = relation(spark, sf, "items").select("item_id", "url")
    pages = items.join(mapped(spark, sf, HEADED).select(F.col("page_id").alias("item_id"), "html"), "item_id")
    repos = relation(spark, sf, "items").where("kind = 'repo'").select(F.get_json_object("metadata", "$.github_repo").alias("subject")).distinct()
    return pages.groupBy(F.col("url").alias("subject")).agg(F.min_by("html", "item_id").alias("text")).select(F.lit("page").alias("strategy"), "subject", "text").unionByName(
        repos.select(F.lit("repo").alias("strategy"), "subject", F.concat(F.lit(BLURB), "subject").alias("text")))


@query("a19_describe_apply", f"""
SELECT i.item_id, CASE WHEN nw THEN words ELSE summary END AS summary, CASE WHEN na THEN art ELSE media_url END AS media_url, CASE WHEN nw THEN NULL ELSE i.external_id END AS embedded_hash,
   CASE WHEN nw THEN 'pending' ELSE triage_state END AS triage_state, CASE WHEN nw THEN NULL ELSE triage_score END AS triage_score
FROM items i LEFT JOIN (SELECT item_id, coalesce(ws AND words IS NOT NULL, false) AS nw, coalesce(wm AND art IS NOT NULL, false) AS na, words, art FROM (
   SELECT p.item_id, p.ws, p.wm, coalesce(b.summary, CASE WHEN contains(steps, 'repo|') THEN '{BLURB}' || {js('github_repo')} END, CASE WHEN contains(steps, 'page|') AND f.page_id % 5 = 2 THEN 'A plain description of page ' || f.page_id || ' and what is on it.' END) AS words,
     CASE WHEN contains(steps, 'page|') THEN CASE f.page_id % 3 WHEN 0 THEN regexp_extract(y.url, '^([a-z]+://[^/?#]*)', 1) || '/img/' || f.page_id || '.png'
       WHEN 1 THEN regexp_extract(y.url, '^([a-z]+://[^?#]*/)', 1) || 'pic.jpg' END END AS art
   FROM pl p JOIN items y ON y.item_id = p.item_id LEFT JOIN first_page f ON f.url = y.url AND contains(p.steps, 'page|' || y.url)
   LEFT JOIN body_words b ON b.item_id = p.item_id AND starts_with(p.steps, 'body')) z) w ON w.item_id = i.item_id""", {
    "pl": PLAN, "first_page": "SELECT i.url, min(p.page_id) AS page_id FROM items i JOIN @pages p ON p.page_id = i.item_id GROUP BY i.url",
    "body_blocks": "SELECT item_id, unnest(string_split(body, chr(10) || chr(10))) AS b, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS n FROM items WHERE body <> ''",
    "body_words": f"""SELECT item_id, prose AS summary FROM (SELECT item_id, arg_min(prose, n) AS prose FROM (SELECT item_id, n, {FLATB} AS prose FROM body_blocks WHERE NOT regexp_matches({BLOCK}, '^(#|\\||>|-|\\*|\\+|```|<|\\[!|:)') AND {BLOCK} <> '') x WHERE length(prose) > 40 GROUP BY item_id) q"""})
def describe_apply(spark, sf):
    items = relation(spark, sf, "items").withColumn("embedded_hash", F.col("external_id"))
    after, _ = D.apply(items, planned(spark, sf, None), fetched(spark, sf))
    return after.select("item_id", "summary", "media_url", "embedded_hash", "triage_state", "triage_score")


@query("a20_announced_feeds", f"""
SELECT page_id, {ROOT} || '/feed/' || page_id || '?a=1&b=2 https://f.example.org/a?x=1&y=2' AS feeds FROM @pages WHERE page_id % 4 = 0""")
def announced_feeds(spark, sf):
    rows = mapped(spark, sf, HEADED).select("page_id", P.announced_feeds(F.col("html"), F.col("url")).alias("f"))
    return rows.where(F.size("f") > 0).select("page_id", F.array_join("f", " ").alias("feeds"))


@query("a21_payload_kinds", """
SELECT 'feed' AS kind, least(20, (SELECT count(*) FROM @documents) - b * 20) AS entries, count(*) AS n FROM (SELECT DISTINCT CAST(floor(doc_id / 20) AS BIGINT) AS b FROM @documents) x GROUP BY 1, 2
UNION ALL SELECT 'news sitemap', count(*), 1 FROM @pages GROUP BY floor(page_id / 25)
UNION ALL SELECT 'sitemap', 0, 0 WHERE false
UNION ALL SELECT 'web page', 0, count(*) FROM @pages
UNION ALL SELECT 'empty', 0, count(*) FROM @labels
UNION ALL SELECT 'not a feed', 0, count(*) FROM (SELECT DISTINCT CAST(floor(doc_id / 20) AS BIGINT) FROM @documents) y""")
def payload_kinds(spark, sf):
    rss = rss_payloads(spark, sf).select(F.lit("r").alias("url"), "body")
    maps = sitemap_payloads(spark, sf).where("NOT is_root").select("url", "body")
    html = table(spark, sf, "pages").select("url", F.col("html").alias("body"))
    empty = table(spark, sf, "labels").select(F.lit("e").alias("url"), F.lit("").alias("body"))
    json = hub_payloads(spark, sf).select(F.lit("j").alias("url"), "body")
    rows = feeds.classify(rss.unionByName(maps).unionByName(html).unionByName(empty).unionByName(json))
    total = rows.where("kind <> 'news sitemap'").groupBy("kind", "entries").agg(F.count("*").alias("n"))
    return total.unionByName(rows.where("kind = 'news sitemap'").select("kind", "entries", F.lit(1).cast("long").alias("n")))
