"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X
from storyloom.functions import urls as U
from storyloom.functions import vectors as V
from storyloom.model import EPOCH_START, NOW, relation, table
from storyloom.plans.registry import query

# SQL spelling of strip_html for the entities the pages hold.
FLAT = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&quot;', '"'), '&amp;?', '&', 'g'),
  '[\s\x{{a0}}]+', ' ', 'g'), '[\s]+([,.;:!?)\]}}])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g')), '')"""
URLRE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
HOST = f"lower(regexp_extract(url, '{URLRE}', 2))"


@query("c01_strip_html", "SELECT page_id, " + FLAT.format("html") + " AS plain FROM @pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"))


BOILER = "'arXiv:2401.1v1 Announce Type: new Abstract: ' || text || ' Article URL: https://a.b/c Comments URL: http://x Points: 12 # Comments: 3'"


@query("c02_strip_boilerplate", f"""
SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace({BOILER},
  '(?i)^\\s*arxiv:\\s*\\S+\\s*(?:announce\\s+type:\\s*\\w+)?\\s*(?:abstract:)?\\s*', ''),
  '(?i)article url:\\s*\\S+|comments url:\\s*\\S+|points:\\s*\\d+|#\\s*comments:\\s*\\d+', '', 'g'), '\\s+', ' ', 'g')), '') AS cleaned
FROM @documents""")
def strip_boilerplate(spark, sf):
    raw = F.concat(
        F.lit("arXiv:2401.1v1 Announce Type: new Abstract: "), F.col("text"),
        F.lit(" Article URL: https://a.b/c Comments URL: http://x Points: 12 # Comments: 3"),
    )
    return table(spark, sf, "documents").select("doc_id", X.strip_boilerplate(raw).alias("cleaned"))


def _truncate_sql(col: str, n: int) -> str:
    head = f"substring({col}, 1, {n})"
    space = f"({n} - instr(reverse({head}), ' '))"
    return (f"CASE WHEN length({col}) <= {n} THEN {col} WHEN instr(reverse({head}), ' ') > 0 AND {space} > {n} * 0.6 "
            f"THEN rtrim(substring({col}, 1, {space}), ' ' || chr(10) || chr(9)) || '…' "
            f"ELSE rtrim({head}, ' ' || chr(10) || chr(9)) || '…' END")


@query("c03_truncate", f"SELECT doc_id, {_truncate_sql('text', 320)} AS short, {_truncate_sql('text', 2000)} AS summary FROM @documents")
def truncate(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", X.truncate(text, 320).alias("short"), X.truncate(text, 2000).alias("summary")
    )


def canonical_sql(col: str, tag: str = "") -> str:
    part = lambda n: f"regexp_extract(trim({col}), '{URLRE}', {n})"
    pairs = f"list_filter(string_split({part(4)}, '&'), lambda p: p <> '')"
    kept = (f"list_sort(list_filter({pairs}, lambda p: NOT regexp_matches(lower(split_part(p, '=', 1)), "
            f"'^(utm_|mc_|pk_|_hs)') AND lower(split_part(p, '=', 1)) NOT IN "
            f"({', '.join(repr(n) for n in U.TRACKING_NAMES)})))")
    query_text = f"array_to_string(list_transform({kept}, lambda p: CASE WHEN instr(p, '=') > 0 THEN p ELSE p || '=' END), '&')"
    path = f"CASE WHEN rtrim({part(3)}, '/') = '' THEN '/' ELSE rtrim({part(3)}, '/') END"
    scheme = f"CASE WHEN lower({part(1)}) IN ('http', 'https', '') THEN 'https' ELSE lower({part(1)}) END"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower({part(2)}), '^www\\.', ''), ':80$', ''), ':443$', '')"
    return (f"CASE WHEN {part(2)} = '' THEN trim({col}) ELSE {scheme} || '://' || {host} || {path} || "
            f"CASE WHEN {query_text} = '' THEN '' ELSE '?' || {query_text} END END")


@query("c04_canonical_url", f"""
SELECT 'page' AS kind, page_id AS id, {canonical_sql('url')} AS canonical FROM @pages
UNION ALL SELECT 'item', item_id, {canonical_sql('url')} FROM items""")
def canonical(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    items = relation(spark, sf, "items").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "url")
    return pages.unionByName(items).select("kind", "id", U.canonical(F.col("url")).alias("canonical"))


@query("c05_domain", f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS domain FROM @pages")
def domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query("c06_site", f"SELECT page_id, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS site FROM @pages")
def site(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.site(F.col("url")).alias("site"))


@query("c07_clean_names", """
SELECT doc_id, regexp_replace(regexp_replace(word, '[.,);:''"]+$', ''), '\\.git$', '') AS repo,
       regexp_replace('2401.' || doc_id || 'v' || n_chars, 'v\\d+$', '') AS paper,
       CASE WHEN regexp_replace(regexp_replace(word, '[.,);:''"]+$', ''), '\\.git$', '') <> '' THEN
       lower(source) || '/' || regexp_replace(regexp_replace(regexp_extract(lower(word), '^[a-z.]+'), '[.,);:''"]+$', ''), '\\.git$', '') END AS from_url,
       lower(source) || '/' || regexp_replace(regexp_replace(lower(word), '[.,);:''"]+$', ''), '\\.git$', '') AS from_pair
FROM (SELECT doc_id, n_chars, source, regexp_extract(text, '([A-Za-z]+[.,]*)', 1) || CASE WHEN doc_id % 2 = 0 THEN '.git.' ELSE '' END AS word
        FROM @documents) x WHERE word <> ''""")
def clean_names(spark, sf):
    word = F.concat(F.regexp_extract("text", "([A-Za-z]+[.,]*)", 1), F.when(F.col("doc_id") % 2 == 0, F.lit(".git.")).otherwise(F.lit("")))
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", "source", word.alias("word")).where("word <> ''")
    return rows.select(
        "doc_id",
        U.clean_repo(F.col("word")).alias("repo"),
        U.strip_version(F.concat(F.lit("2401."), F.col("doc_id").cast("string"), F.lit("v"), F.col("n_chars").cast("string"))).alias("paper"),
        U.repo_from(F.concat(F.lit("https://github.com/"), F.initcap("source"), F.lit("/"), F.col("word"))).alias("from_url"),
        U.repo_from(F.concat(F.lit(" /"), F.col("source"), F.lit("/"), F.col("word"), F.lit("/ "))).alias("from_pair"),
    )


@query("c08_specific_path", f"SELECT page_id, length(trim(regexp_extract(url, '{URLRE}', 3), '/')) > 2 AS specific FROM @pages")
def specific_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.has_specific_path(F.col("url")).alias("specific"))


JSON = "CASE WHEN starts_with(metadata, '{') THEN metadata ELSE '{}' END"


def js(key: str) -> str:
    return f"json_extract_string({JSON}, '$.{key}')"


EMBED_SQL = rf"""trim(regexp_replace(concat_ws(' ', nullif(title, ''),
  CASE kind WHEN 'model' THEN replace({js('pipeline_tag')}, '-', ' ') || ' ' || array_to_string(list_filter(CAST(json_extract({JSON}, '$.tags') AS VARCHAR[]), lambda t: instr(t, ':') = 0), ' ')
            WHEN 'repo' THEN nullif(body, '')
            WHEN 'discussion' THEN concat_ws(' ', regexp_replace(lower(regexp_extract({js('outbound_url')}, '^[a-z]+://([^/]*)', 1)), '^www\.', ''), nullif(summary, ''))
            ELSE nullif(summary, '') END), '^\s+|\s+$', '', 'g'))"""


@query("c09_embedding_text", f"SELECT item_id, {EMBED_SQL} AS embedding_text FROM items")
def embedding_text(spark, sf):
    return relation(spark, sf, "items").select("item_id", I.embedding_text().alias("embedding_text"))


@query("c10_parse_time", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS from_zone, CAST(floor(epoch(ts)) AS BIGINT) - 7200 AS from_offset,
       CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS from_date, CAST(NULL AS BIGINT) AS from_junk,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM @events""")
def parse_time(spark, sf):
    ts = F.col("ts").cast("timestamp")
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id",
        I.parse_time(F.concat(plain, F.lit("Z"))).alias("from_zone"),
        I.parse_time(F.concat(plain, F.lit("+02:00"))).alias("from_offset"),
        I.parse_time(F.date_format(ts, "yyyy-MM-dd")).alias("from_date"),
        I.parse_time(F.concat(F.lit("on "), plain)).alias("from_junk"),
        I.iso(F.unix_seconds(ts)).alias("iso"),
    )


@query("c11_age_hours", f"""
SELECT item_id, round(coalesce(greatest(({NOW} - published_s) / 3600.0, 0.0), 8760.0), 6) AS hours,
       round(coalesce(greatest(({EPOCH_START + 864000} - published_s) / 3600.0, 0.0), 8760.0), 6) AS hours_then FROM items""")
def age_hours(spark, sf):
    published = F.col("published_s")
    return relation(spark, sf, "items").select(
        "item_id", F.round(I.age_hours(published, NOW), 6).alias("hours"),
        F.round(I.age_hours(published, EPOCH_START + 864000), 6).alias("hours_then"),
    )


@query("c12_slug", """
SELECT doc_id, CASE WHEN s = '' THEN 'topic' ELSE s END AS slug FROM (
  SELECT doc_id, substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS s FROM @documents) x""")
def slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("c13_short_name", r"""
SELECT item_id, array_to_string(list_filter(string_split_regex(string_split_regex(title, ':\s| [–—-] ')[1], '\s+'), lambda w: w <> '')[1:6], ' ') AS short_name
FROM items""")
def short_name(spark, sf):
    return relation(spark, sf, "items").select("item_id", X.short_name(F.col("title")).alias("short_name"))


@query("c14_words", rf"""
SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^\pL\pN]+'),
  lambda w: length(w) >= 2 AND w NOT IN ({', '.join(repr(w) for w in X.SMALL_WORDS)})), ' ') AS words FROM @documents""")
def words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.words(F.col("text")), " ").alias("words"))


@query("c15_metadata_access", f"""
SELECT item_id, {js('arxiv_id')} AS arxiv_id, {js('hf_id')} AS hf_id, {js('github_repo')} AS github_repo,
       {js('outbound_url')} AS outbound_url, CAST({js('num_comments')} AS BIGINT) AS num_comments,
       coalesce(json_array_length({JSON}, '$.links'), 0)::BIGINT AS links FROM items""")
def metadata_access(spark, sf):
    rows = relation(spark, sf, "items").select("item_id", I.metadata().alias("m"))
    links = F.coalesce(F.size("m.links").cast("long"), F.lit(0))
    return rows.select("item_id", "m.arxiv_id", "m.hf_id", "m.github_repo", "m.outbound_url", "m.num_comments",
                       F.when(F.col("m.links").isNull(), F.lit(0).cast("long")).otherwise(links).alias("links"))


POINTS_SQL = f"nullif(coalesce(CAST({js('points')} AS BIGINT), CAST({js('upvotes')} AS BIGINT), CAST({js('likes')} AS BIGINT)), 0)"
COMMENTS_SQL = f"nullif(CAST({js('num_comments')} AS BIGINT), 0)"


@query("c16_engagement", f"SELECT item_id, {POINTS_SQL} AS points, {COMMENTS_SQL} AS comments FROM items")
def engagement(spark, sf):
    rows = relation(spark, sf, "items").select("item_id", I.metadata().alias("m"))
    return rows.select("item_id", I.points(F.col("m")).alias("points"), I.comments(F.col("m")).alias("comments"))


@query("c17_looks_like_site", r"""
SELECT page_id, regexp_matches(trim(url), '(?i)^(https?://)?[\pL\pN_-]+(\.[\pL\pN_-]+)+(/\S*)?$') AS whole,
       true AS host, false AS prose
FROM @pages""")
def looks_like_site(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", U.looks_like_site(url).alias("whole"), U.looks_like_site(U.domain(url)).alias("host"),
        U.looks_like_site(F.concat(F.lit("about "), url)).alias("prose"),
    )


@query("c18_ago_label", f"""
SELECT item_id, CASE WHEN published_s IS NULL THEN '' WHEN ({NOW} - published_s) / 3600.0 < 1 THEN 'now'
  WHEN ({NOW} - published_s) / 3600.0 < 24 THEN CAST(floor(({NOW} - published_s) / 3600.0) AS BIGINT) || 'h'
  ELSE CAST(floor(({NOW} - published_s) / 86400.0) AS BIGINT) || 'd' END AS label FROM items""")
def ago_label(spark, sf):
    hours = (F.lit(NOW) - F.col("published_s")) / 3600.0
    return relation(spark, sf, "items").select("item_id", X.ago_label(hours).alias("label"))


def _count_sql(role: str, label: str) -> str:
    n = f"count(*) FILTER (si.role = '{role}')"
    return f"CASE WHEN {n} > 0 THEN {n} || ' {label}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END END"


@query("c19_signal", f"""
SELECT si.story_id, concat_ws(' · ', {', '.join(_count_sql(r, w) for r, w in X.SIGNAL_LABELS)},
   CASE WHEN count(DISTINCT i.source) > 1 THEN count(DISTINCT i.source) || ' sources' END) AS signal
FROM story_items si JOIN items i ON i.item_id = si.item_id GROUP BY si.story_id""")
def signal(spark, sf):
    members = relation(spark, sf, "story_items").join(relation(spark, sf, "items").select("item_id", "source"), "item_id")
    counts = members.groupBy("story_id").agg(
        F.countDistinct("source").alias("sources"),
        *[F.count_if(F.col("role") == r).alias(r) for r, _ in X.SIGNAL_LABELS],
    )
    return counts.select("story_id", X.signal({r: F.col(r) for r, _ in X.SIGNAL_LABELS}, F.col("sources")).alias("signal"))


@query("c20_lift_bars", """
SELECT item_id, round(pow(2, gap / 48), 6) AS lift, CAST(CASE WHEN pow(2, gap / 48) >= 2 THEN 3 WHEN pow(2, gap / 48) >= 1.5 THEN 2 ELSE 1 END AS INTEGER) AS bars
FROM (SELECT item_id, n_chars % 97 + 0.25 AS gap FROM items) x""")
def lift_bars(spark, sf):
    from storyloom.operators.feed import bars, lift

    rows = relation(spark, sf, "items").select("item_id", lift((F.col("n_chars") % 97 + 0.25).cast("double")).alias("raw"))
    return rows.select("item_id", F.round("raw", 6).alias("lift"), bars(F.col("raw")).alias("bars"))


@query("c21_vector_math", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
       round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm,
       array_to_string(list_transform(a.embedding::DOUBLE[], lambda x: CAST(greatest(-127, least(127, round_even(x / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * 127, 0))) AS INTEGER)), ',') AS packed
FROM @embeddings a JOIN @embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_math(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rows.join(after, "vec_id").select(
        "vec_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(V.norm(F.col("a")), 6).alias("norm"),
        F.array_join(V.packed(V.unit(F.col("a"))), ",").alias("packed"),
    )
