"""RSS, Atom and preprint feeds: payload text in, items out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X
from storyloom.sources.raw import filled, raw_item

ATOM = ("entry array<struct<title:string, id:string, link:array<struct<_href:string,_rel:string,_type:string>>, author:array<struct<name:string>>, "
        "summary:string, published:string, updated:string, category:array<struct<_term:string>>, `arxiv:primary_category`:struct<_term:string>, "
        "`media:content`:array<struct<_url:string>>, `media:thumbnail`:array<struct<_url:string>>>>")


# The zone names of RFC 822.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
         "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def feed_time(text: Column) -> Column:
    """RFC 822 (zones by name or number, seconds or none, years of two digits or four) or ISO 8601 text as epoch seconds."""
    bare = F.regexp_replace(F.btrim(text), "^[A-Za-z]{3,9},?\\s+", "")
    zone = F.upper(F.regexp_extract(bare, "\\s([A-Za-z]{1,3})$", 1))
    offset = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone)
    named = F.coalesce(F.concat(F.regexp_replace(bare, "\\s[A-Za-z]{1,3}$", " "), offset), bare)
    forms = ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "d MMM yy HH:mm:ss xx")
    return F.coalesce(I.parse_time(text), *[F.unix_seconds(F.try_to_timestamp(named, F.lit(form))) for form in forms])


def _first(values: Column, field: str) -> Column:
    return F.get(F.filter(F.transform(values, lambda v: v[field]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))


def links(html: Column) -> Column:
    """Distinct link targets of a fragment, in order."""
    found = X.decode_each(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1)))
    return F.array_distinct(F.transform(found, lambda h: F.btrim(h)))


#: One entry of RSS 0.9 to 2.0 (RSS 1.0 names it in an attribute) or of Atom.
ENTRY = (
    "title string, link array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>, guid string, id string, `_rdf:about` string, "
    "author array<struct<_VALUE:string,name:string>>, `dc:creator` string, description string, summary string, `content:encoded` string, content string, "
    "pubDate string, published string, updated string, `dc:date` string, enclosure array<struct<_url:string,_type:string>>, "
    "`media:content` array<struct<_url:string>>, `media:thumbnail` array<struct<_url:string>>, _corrupt_record string"
)
CHILD = r"(?s)<([A-Za-z][\w:.-]*)(?:\s[^<>]*)?(?:/>|>.*?</\1\s*>)"


def _escaped(xml: Column) -> Column:
    """Control characters taken out, and an ampersand that opens no entity of XML made one."""
    plain = F.regexp_replace(xml, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(plain, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def _whole_children(xml: Column, opening: Column, closing: Column) -> Column:
    """The entry of the children that are whole; markup inside one that is no XML becomes its text."""
    inside = F.substr(xml, F.length(opening) + 1)
    children = F.regexp_extract_all(inside, F.lit(CHILD), F.lit(0))
    as_text = F.transform(children, lambda c: F.when(
        F.contains(c, F.lit("<![CDATA[")) | ~F.regexp_like(c, F.lit(r"(?s)^<[^<>]*>[^<]*<(?!/?[\w:.-]+\s*>$)")), c).otherwise(
        F.regexp_replace(c, r"(?s)^(<[^<>]*[^/<>]>)(.*)(</[^<>]*>)$", "$1<![CDATA[$2]]>$3")))
    return F.concat(opening, F.array_join(as_text, ""), closing)


def _settled(rows: DataFrame) -> DataFrame:
    """``rows``, computed once a row: a condition on a generator's output stays above it, so the columns
    it reads are not worked out a second time, each time they are named, to test it."""
    return rows.select(F.explode_outer(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


def scan(payloads: DataFrame) -> DataFrame:
    """(feed, place, e, piece): every entry of a payload (feed, body) parsed on its own; ``e`` is null where that fails.

    A payload is split where entries open, so a fault costs the entry it is in, and
    a payload that breaks off keeps all before the break. An entry that is no XML is
    parsed again with its ampersands mended, then from those of its children that are whole.
    """
    cut = F.split("body", r"(?=<(?:item|entry)[\s>])")
    rows = payloads.where("body IS NOT NULL").select("feed", F.posexplode(cut).alias("place", "piece")).where(F.regexp_like("piece", F.lit(r"^<(?:item|entry)[\s>]")))
    name = F.when(F.startswith("piece", F.lit("<item")), "item").otherwise("entry")
    rows = rows.withColumn("closing", F.concat(F.lit("</"), name, F.lit(">")))
    rows = rows.withColumn("piece", F.expr("substring_index(piece, left(closing, length(closing) - 1), 1)"))
    whole = F.concat("piece", "closing")
    opening = F.regexp_extract("piece", r"(?s)^<[^<>]*>", 0)
    # A column that is used several times is computed once in a projection of its own.
    parsed = rows.withColumn("e", F.from_xml(whole, ENTRY))
    good = lambda e: e["_corrupt_record"].isNull()
    parsed = parsed.withColumn("e", F.when(good(F.col("e")), F.col("e")).otherwise(F.from_xml(_escaped(whole), ENTRY)))
    parsed = parsed.withColumn("e", F.when(good(F.col("e")), F.col("e")).when(
        opening != "", F.from_xml(_whole_children(_escaped(F.col("piece")), opening, F.col("closing")), ENTRY)))
    return _settled(parsed.select("feed", "place", F.when(good(F.col("e")), F.col("e")).alias("e"), "piece"))


def entries(payloads: DataFrame) -> DataFrame:
    """Entries of RSS and Atom payloads (feed, body) in one shape, those that cannot be read with a null title and link."""
    page = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    picture = lambda values, at: _first(F.filter(values, lambda x: F.startswith(x["_type"], F.lit("image/"))), at)
    shown = lambda *names: F.coalesce(*[F.when(filled(F.col(n)), F.col(n)) for n in names])
    return scan(payloads).select(
        "feed", "place", F.col("e.title").alias("title"),
        F.coalesce(_first(F.col("e.link"), "_VALUE"), _first(page, "_href")).alias("link"),
        shown("e.guid", "e.id", "e.`_rdf:about`").alias("id"),
        F.coalesce(_first(F.col("e.author"), "name"), _first(F.col("e.author"), "_VALUE"), shown("e.`dc:creator`")).alias("author"),
        shown("e.pubDate", "e.published").alias("published"), shown("e.updated", "e.`dc:date`").alias("updated"),
        shown("e.description", "e.summary", "e.`content:encoded`", "e.content").alias("summary"),
        _first(F.col("e.`media:content`"), "_url").alias("content"), _first(F.col("e.`media:thumbnail`"), "_url").alias("thumbnail"),
        F.coalesce(picture(F.col("e.enclosure"), "_url"), picture(F.filter("e.link", lambda x: x["_rel"] == "enclosure"), "_href")).alias("enclosure"),
        F.col("e").isNotNull().alias("readable"), "piece",
    )


def _addressable(payloads: DataFrame) -> DataFrame:
    return _settled(entries(payloads).withColumn("plain", X.strip_html(F.col("title"))))


def quarantined(payloads: DataFrame) -> DataFrame:
    """(feed, place, reason, piece) of the entries that ``normalise`` leaves out, as they came."""
    reason = F.when(~F.col("readable"), "no XML").when(~filled(F.col("link")), "no link").when(F.col("plain").isNull(), "no title")
    return _addressable(payloads).select("feed", "place", reason.alias("reason"), "piece").where("reason IS NOT NULL")


def normalise(payloads: DataFrame) -> DataFrame:
    """Feed entries as items; one without a link or a title is not addressable (see ``quarantined``)."""
    rows = _addressable(payloads).where(filled(F.col("link")) & F.col("plain").isNotNull())
    summary = X.strip_boilerplate(X.strip_html(F.col("summary")))
    found = links(F.col("summary"))
    meta = F.struct(F.col("feed"), F.when(F.size(found) > 0, found).alias("links"))
    return rows.select(*raw_item(
        F.coalesce(F.when(filled(F.col("id")), F.col("id")), "link"), "article", F.col("link"), F.col("plain"),
        author=F.when(filled(F.col("author")), F.col("author")), published_s=F.coalesce(feed_time(F.col("published")), feed_time(F.col("updated"))),
        summary=summary, media_url=F.coalesce("content", "thumbnail", "enclosure"), metadata=meta,
    ))


PAPER = r"arxiv\.org/abs/([\w.\-/]+?)(?:v(\d+))?$"


def author_line(names: Column) -> Column:
    return F.when(F.size(names) == 0, F.lit(None)).when(F.size(names) <= 2, F.array_join(names, " and ")).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))


def normalise_papers(payloads: DataFrame) -> DataFrame:
    """Preprint entries as items, keyed without the version so a revision updates."""
    rows = payloads.select(F.explode(F.from_xml("body", ATOM)["entry"]).alias("e"))
    page = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    rows = rows.select("e", _first(page, "_href").alias("link"), X.strip_html(F.col("e.title")).alias("plain"))
    paper = F.regexp_extract("link", PAPER, 1)
    rows = rows.where(F.col("plain").isNotNull() & (paper != "")).withColumn("paper", paper)
    names = F.filter(F.transform("e.author", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    version = F.regexp_extract("link", PAPER, 2)
    meta = F.struct(
        F.col("paper").alias("arxiv_id"), F.when(version != "", version).alias("version"), names.alias("authors"),
        F.filter(F.transform("e.category", lambda c: c["_term"]), lambda t: F.coalesce(t, F.lit("")) != "").alias("categories"),
        F.col("e.`arxiv:primary_category`._term").alias("primary_category"), F.concat(F.lit("https://arxiv.org/pdf/"), "paper").alias("pdf_url"),
        F.col("e.updated").alias("updated_at"),
    )
    return rows.select(*raw_item(
        F.col("paper"), "paper", F.concat(F.lit("https://arxiv.org/abs/"), "paper"), F.col("plain"), author=author_line(names),
        published_s=feed_time(F.col("e.published")), summary=X.strip_html(F.col("e.summary")), metadata=meta,
    ))


def classify(payloads: DataFrame) -> DataFrame:
    """What arrived where a feed was expected, and how many entries it has."""
    body = F.col("body")
    has = lambda p: F.regexp_like(body, F.lit(p))
    count = lambda p: F.regexp_count(body, F.lit(p)).cast("long")
    is_feed = has(r"(?i)<(rss|feed|rdf:rdf)[\s>]")
    is_news = has("<urlset") & has("sitemap-news")
    kind = (
        F.when(F.coalesce(body, F.lit("")) == "", "empty").when(is_feed, "feed").when(is_news, "news sitemap").when(has("<urlset"), "sitemap")
        .when(has(r"(?i)^\s*<(?:!doctype\s+html|html)\b"), "web page").otherwise("not a feed")
    )
    n = F.when(is_feed, count(r"<(item|entry)[\s>]")).when(has("<urlset"), count("<url>") + count("<url ")).otherwise(F.lit(0).cast("long"))
    return payloads.select("url", kind.alias("kind"), F.coalesce(n, F.lit(0)).alias("entries"))
