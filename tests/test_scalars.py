"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X
from storyloom.functions import urls as U
from storyloom.operators import identity as D
from storyloom.operators import labels as L
from storyloom.sources import apis


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def texts(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_strip_html(spark):
    got = texts(spark, X.strip_html, ["<p>a</p><p>b</p>", "<b>word</b>.", "&lt;x&gt; &eacute;&#8217;", " <i></i> ", None, "( a ) [ b ]"])
    assert got == ["a b", "word.", "<x> é’", None, None, "(a) [b]"]


def test_strip_boilerplate(spark):
    got = texts(spark, X.strip_boilerplate, ["arXiv:2609.1v1 Announce Type: new Abstract: We show", "Points: 12 # Comments: 3", "plain  text"])
    assert got == ["We show", None, "plain text"]


def test_truncate_cuts_at_a_late_space_only(spark):
    got = texts(spark, lambda c: X.truncate(c, 10), ["short", "abcdefg hijklmn", "ab cdefghijklmn", "0123456789", None])
    assert got == ["short", "abcdefg…", "ab cdefghi…", "0123456789", None]


def test_prose_summary(spark):
    long = "This is the first real paragraph of the card, long enough."
    doc = f"---\nlicense: mit\n---\n# Title\n\n![b](x)\n\n- a list of many things that is long enough to count\n\n{long} [link](http://x)\n\nmore"
    assert texts(spark, X.prose_summary, [doc, "# only", None]) == [long + " link", None, None]


def test_names(spark):
    assert texts(spark, X.short_name, ["One two: three", "A – B", "one two three four five six seven", "a-b c"]) == ["One two", "A", "one two three four five six", "a-b c"]
    assert texts(spark, X.slug, ["Hello, World!", "***"]) == ["hello-world", "topic"]
    assert texts(spark, lambda c: F.array_join(X.words(c), " "), ["The War in Göteborg, AI & a"]) == ["war göteborg ai"]


@pytest.mark.parametrize("text,name,hit", [
    ("software wars", "war", True), ("software", "war", False), ("new agents here", "agent", True), ("boxes", "box", True), ("x", "the of", False)])
def test_names_all(spark, text, name, hit):
    assert one(spark, X.names_all(F.lit(text), F.lit(name))) is hit


def test_canonical(spark):
    cases = {
        "http://www.Example.com:80/a/?utm_source=x&b=2&a=1#top": "https://example.com/a?a=1&b=2",
        "https://example.com": "https://example.com/",
        "https://example.com/?ref=x": "https://example.com/",
        "https://example.com/p?q=a%20b&q=": "https://example.com/p?q=&q=a+b",
        "ftp://h/x//": "ftp://h/x",
        "  no host  ": "no host",
        "https://example.com/a?x": "https://example.com/a?x=",
        "https://e.com/?~k=*": "https://e.com/?~k=%2A",
        "": "",
    }
    assert texts(spark, U.canonical, list(cases)) == list(cases.values())


def test_sites_and_repos(spark):
    assert texts(spark, U.site, ["https://blog.google.com/x", "http://user@www.a.co:81/"]) == ["google.com", "a.co"]
    assert texts(spark, U.repo_from, ["https://github.com/Own/Repo.git", "Own/Repo", "/own/repo/", "own", ""]) == ["own/repo", "own/repo", "own/repo", None, None]
    assert texts(spark, U.looks_like_site, ["theverge.com", "AI video", "https://a.b/c"]) == [True, False, True]


def test_url_identifiers(spark):
    cases = {
        "https://arxiv.org/pdf/2401.01234v2": ("arxiv", "2401.01234"),
        "https://huggingface.co/papers/2401.01234": ("arxiv", "2401.01234"),
        "https://huggingface.co/Org/Model": ("hf_model", "org/model"),
        "https://huggingface.co/spaces/x": None,
        "https://github.com/Own/Repo/releases/tag/v1": ("github_release", "own/repo@v1"),
        "https://github.com/Own/Repo.": ("github_repo", "own/repo"),
        "https://github.com/topics/x": None,
        "https://example.com/": None,
        "https://example.com/story?utm_x=1": ("url", "https://example.com/story"),
    }
    got = texts(spark, D.url_identifier, list(cases))
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_extract_reads_metadata_links_and_text(spark):
    meta = '{"arxiv_id":"2401.00001v3","links":["https://a.example.com/one","https://own.example.com/self","https://x.com/share?u=1"]}'
    round_up = '{"links":[' + ",".join(f'"https://s{i}.org/page{i}"' for i in range(4)) + "]}"
    rows = spark.createDataFrame([
        (1, "https://own.example.com/", "See arXiv: 2402.11111", "doi 10.1234/AB.c. and https://github.com/A/B.git", None, meta),
        (2, "https://own.org/", "roundup", None, None, round_up), (3, "https://own.org/", "bad", None, None, "not json")],
        "item_id long, url string, title string, summary string, body string, metadata string")
    got = {}
    for r in D.extract(rows).collect():
        got.setdefault(r["item_id"], set()).add((r["type"], r["value"]))
    assert got == {1: {("arxiv", "2401.00001"), ("arxiv", "2402.11111"), ("doi", "10.1234/ab.c"), ("github_repo", "a/b")}}
    # own.example.com and a.example.com are one site, so the link away is not one.


def test_release_rules(spark):
    tags = ["b11020", "1.0rc1", "v5.15.1", "v5.15.0", "2026.09.22", "v2", "0.0.1a1", "nightly-3"]
    pre = texts(spark, lambda c: apis.is_prerelease(c, F.lit(False)), tags)
    patch = texts(spark, apis.is_patch, tags)
    assert pre == [True, True, False, False, False, False, True, True]
    assert patch == [False, False, True, False, False, False, True, False]


def test_entity_boundaries(spark):
    llama, phi = L.entity_pattern(["Llama"]), L.entity_pattern(["Phi", "Phi-3.5"])
    hit = lambda p, vs: texts(spark, lambda c: F.regexp_like(c, F.lit(p)), vs)
    assert hit(llama, ["Llama.", "llama.cpp", "a Llama model", "étéLlama", "x.llama"]) == [True, False, True, False, False]
    assert hit(phi, ["philosophy", "Phi", "phi-3.5!"]) == [False, True, True]


def test_times(spark):
    assert texts(spark, I.parse_time, ["1970-01-01T00:01:00Z", "1970-01-01T02:00:00+02:00", "1970-01-02", "junk", None]) == [60, 0, 86400, None, None]
