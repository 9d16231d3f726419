"""Sources read whole: no cut on maps, heads, links or texts; addresses as a browser resolves them."""

from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.functions import urls as U
from storyloom.sources import feeds, sitemaps
from storyloom.sources import pages as P


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_every_child_map_is_read(spark):
    children = "".join(f"<sitemap><loc>http://m/{n}</loc></sitemap>" for n in range(25))
    rows = [("s", "http://m/i", f"<sitemapindex>{children}</sitemapindex>", True)]
    rows += [("s", f"http://m/{n}", f"<urlset><url><loc>http://p/{n}</loc><lastmod>2026-01-01</lastmod></url></urlset>", False) for n in range(25)]
    payloads = spark.createDataFrame(rows, "site string, url string, body string, is_root boolean")
    assert sitemaps.entries(payloads).select("loc").distinct().count() == 25


def test_long_heads_and_texts_stay_whole(spark):
    html = "<head>" + "<!-- x -->" * 30_000 + '<meta name="description" content="' + "word " * 400 + '"></head>'
    head = spark.createDataFrame([(html,)], "v string").withColumn("meta", P.head_meta(F.col("v")))
    assert len(head.select(P.description(F.col("meta")).alias("d")).first()["d"]) == 5 * 400 - 1
    prose = "long prose " * 200
    assert one(spark, prose, X.prose_summary) == prose.strip()


def test_all_links_of_an_entry(spark):
    html = "".join(f'<a href="http://e/{n}?a=1&#38;b=2">x</a>' for n in range(40))
    found = one(spark, html, feeds.links)
    assert len(found) == 40 and found[0] == "http://e/0?a=1&b=2"


def test_prose_opening_with_an_encoded_tag_is_prose(spark):
    text = "&lt;b&gt; is how this first paragraph opens, and it is long enough.\n\nA second paragraph that is also long enough to count."
    assert one(spark, text, X.prose_summary) == "<b> is how this first paragraph opens, and it is long enough."


def test_dot_segments(spark):
    cases = {
        "../img/x.png": "https://e.org/a/img/x.png", "./x.png": "https://e.org/a/b/x.png", "/../../x": "https://e.org/x", "..": "https://e.org/a/",
        "x/../y?q=../z": "https://e.org/a/b/y?q=../z", "?q=1": "https://e.org/a/b/c?q=1", "//f.org/../x": "https://f.org/../x", "http://f.org/x": "http://f.org/x",
    }
    for ref, want in cases.items():
        assert one(spark, ref, lambda v: U.resolve(F.lit("https://e.org/a/b/c"), v)) == want


def test_feed_addresses_are_decoded(spark):
    html = '<link rel="alternate" type="application/rss+xml" href="../f?a=1&#38;b=2"><link rel="stylesheet" href="/s">'
    assert one(spark, html, lambda v: P.announced_feeds(v, F.lit("https://e.org/a/b/"))) == ["https://e.org/a/f?a=1&b=2"]
    assert one(spark, "<p>", lambda v: P.announced_feeds(v, F.lit("https://e.org/"))) == []


def test_random_pairs_are_as_many_as_asked(spark):
    from storyloom.operators import calibrate

    kept = spark.range(300).select(F.col("id").alias("item_id"))
    rows = calibrate.random_pairs(kept, 4000).collect()
    assert 3700 < len(rows) <= 4000 and all(r.a < r.b for r in rows) and len({(r.a, r.b) for r in rows}) == len(rows)
    assert calibrate.random_pairs(kept.limit(0), 10).count() == 0


def items_of(spark, body):
    rows = spark.createDataFrame([("http://f", body)], "feed string, body string")
    return [r.asDict() for r in feeds.normalise(rows).collect()], {r.place: r.reason for r in feeds.quarantined(rows).collect()}


def test_a_feed_with_bare_ampersands_keeps_its_entries(spark):
    body = "<rss><channel><title>R&D</title><item><title>Q&A at AT&T</title><link>http://x/?a=1&b=2</link></item><item><title>second</title><link>http://x/2</link><guid isPermaLink='false'>g2</guid></item></channel></rss>"
    got, failed = items_of(spark, body)
    assert [(r["title"], r["url"], r["external_id"]) for r in got] == [("Q&A at AT&T", "http://x/?a=1&b=2", "http://x/?a=1&b=2"), ("second", "http://x/2", "g2")] and not failed


def test_a_cut_off_feed_keeps_what_arrived(spark):
    body = "<rss><channel><item><title>one</title><link>http://x/1</link></item><item><title>two</title><link>http://x/2</link><descr"
    got, failed = items_of(spark, body)
    assert [r["url"] for r in got] == ["http://x/1", "http://x/2"] and not failed
    got, failed = items_of(spark, body[:body.index("<link>http://x/2") + 9])
    assert [r["url"] for r in got] == ["http://x/1"] and failed == {2: "no link"}


def test_an_entry_of_no_xml_costs_only_itself(spark):
    body = ("<rss><channel><item><title>a</title><link>http://x/a</link><description>one <b>two</description></item>"
            "<item><title>b</title><link>http://x/b</item><item <title>c</title></item><item><title>d</title><link>http://x/d</link></item></channel></rss>")
    got, failed = items_of(spark, body)
    assert [(r["title"], r["summary"]) for r in got] == [("a", "one two"), ("d", None)]
    assert failed[2] == "no link" and set(failed) == {2, 3}


def test_rss_one_and_its_modules(spark):
    body = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel rdf:about="http://c"><title>t</title></channel>'
            '<item rdf:about="http://x/id"><title>First</title><link>http://x/1</link><dc:creator>Ann</dc:creator><dc:date>2026-01-02T03:04:05Z</dc:date>'
            '<content:encoded><![CDATA[<p>Whole &amp; long</p>]]></content:encoded></item></rdf:RDF>')
    got, failed = items_of(spark, body)
    assert not failed and [(r["external_id"], r["url"], r["author"], r["published_s"], r["summary"]) for r in got] == [("http://x/id", "http://x/1", "Ann", 1767323045, "Whole & long")]


def test_atom_entries_with_content_and_pictures(spark):
    body = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title type="html">A &lt;b&gt;b&lt;/b&gt;</title><link rel="self" href="http://x/self"/><link href="http://x/1"/>'
            '<link rel="enclosure" type="image/png" href="http://x/p.png"/><author><name>Bo</name></author><content type="html">&lt;p&gt;text&lt;/p&gt;</content><updated>2026-01-02T00:00:00Z</updated></entry></feed>')
    got, _ = items_of(spark, body)
    assert [(r["external_id"], r["title"], r["url"], r["author"], r["summary"], r["media_url"], r["published_s"]) for r in got] == [("i", "A b", "http://x/1", "Bo", "text", "http://x/p.png", 1767312000)]


def test_feed_times(spark):
    when = {"Fri, 02 Jan 2026 03:04:05 GMT": 1767323045, "2 Jan 2026 03:04:05 +0000": 1767323045, "Thu, 01 Jan 2026 22:04:05 EST": 1767323045, "Thu, 01 Jan 2026 19:04 PST": 1767323040,
            "Thursday, 01 Jan 26 20:04:05 MST": 1767323045, "2026-01-02T03:04:05Z": 1767323045, "nonsense": None, "Fri, 02 Jan 2026 03:04:05 XYZ": None}
    rows = spark.createDataFrame([(t,) for t in when], "v string").select("v", feeds.feed_time(F.col("v")).alias("s"))
    assert {r.v: r.s for r in rows.collect()} == when


def test_an_entry_is_parsed_once_however_its_items_are_filtered(spark):
    payloads = spark.createDataFrame([("f", "<rss><item><title>a &amp;amp; b</title><link>http://e/1</link></item><item><title>no link</title></item></rss>")], "feed string, body string")
    for rows, kept in ((feeds.normalise(payloads), 1), (feeds.quarantined(payloads), 1)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # As it comes, with its ampersands mended, from its whole children; a filter moved below would name them again.
        assert plan.count("from_xml(") == 3
        assert rows.count() == kept
