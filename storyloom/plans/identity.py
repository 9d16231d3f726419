"""Identifier extraction and exact joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import urls as U
from storyloom.model import relation, spread_relation, table
from storyloom.operators import identity as D
from storyloom.plans.registry import query
from storyloom.plans.scalars import canonical_sql, js, JSON, URLRE
from storyloom.session import cut_lineage


def clean_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[.,);:''\"]+$', ''), '\\.git$', '')"


AX = r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
GH = r"(?i)github\.com/([\pL\pN_.-]+)/([\pL\pN_.-]+)"
HF = r"(?i)huggingface\.co/([\pL\pN_.-]+)/([\pL\pN_.-]+)"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def identifier_sql(u: str) -> str:
    """type|value of a URL."""
    section, hub = f"lower(regexp_extract({u}, '{HF}', 1))", clean_sql(f"lower(regexp_extract({u}, '{HF}', 2))")
    owner, repo = f"lower(regexp_extract({u}, '{GH}', 1))", clean_sql(f"lower(regexp_extract({u}, '{GH}', 2))")
    canon = canonical_sql(u)
    return f"""CASE WHEN regexp_matches({u}, '{AX}') THEN 'arxiv|' || regexp_extract({u}, '{AX}', 1)
  WHEN regexp_matches({u}, '{HF}') THEN CASE WHEN {section} = 'papers' AND regexp_matches({hub}, '^\\d{{4}}\\.\\d{{4,5}}$') THEN 'arxiv|' || {hub}
       WHEN {section} IN {_in(D.HUB_SECTIONS)} OR {hub} = '' THEN NULL ELSE 'hf_model|' || {section} || '/' || {hub} END
  WHEN regexp_matches({u}, '{GH}') THEN CASE WHEN {owner} IN {_in(D.CODE_SECTIONS)} OR {repo} = '' THEN NULL
       WHEN regexp_matches({u}, '/releases/tag/[^/?#]+') THEN 'github_release|' || {owner} || '/' || {repo} || '@' || regexp_extract({u}, '/releases/tag/([^/?#]+)', 1)
       ELSE 'github_repo|' || {owner} || '/' || {repo} END
  WHEN length(trim(regexp_extract({canon}, '{URLRE}', 3), '/')) > 2 THEN 'url|' || {canon} END"""


# Each URL a query classifies: page addresses and links made from item ids.
URLS_SQL = """SELECT page_id AS id, 'page' AS form, url FROM @pages
UNION ALL SELECT doc_id, 'release', 'https://github.com/' || source || '/Repo.git/releases/tag/v1.' || doc_id FROM @documents
UNION ALL SELECT doc_id, 'hub', 'https://huggingface.co/' || CASE doc_id % 3 WHEN 0 THEN 'papers/2401.' || (10000 + doc_id % 9) WHEN 1 THEN 'spaces/X' ELSE source || '/Model' || doc_id END FROM @documents
UNION ALL SELECT doc_id, 'section', 'https://github.com/' || CASE doc_id % 2 WHEN 0 THEN 'topics/a' ELSE source || '/b,' END FROM @documents"""


@query("d02_url_classification", f"SELECT id, form, split_part(k, '|', 1) AS type, substring(k, instr(k, '|') + 1) AS value FROM (SELECT id, form, {identifier_sql('url')} AS k FROM ({URLS_SQL}) u) x WHERE k IS NOT NULL")
def url_classification(spark, sf):
    docs = table(spark, sf, "documents")
    n = F.col("doc_id")
    text = n.cast("string")
    made = lambda form, url: docs.select(n.alias("id"), F.lit(form).alias("form"), url.alias("url"))
    hub = F.when(n % 3 == 0, F.concat(F.lit("papers/2401."), (n % 9 + 10000).cast("string"))).when(n % 3 == 1, F.lit("spaces/X")).otherwise(F.concat("source", F.lit("/Model"), text))
    section = F.when(n % 2 == 0, F.lit("topics/a")).otherwise(F.concat("source", F.lit("/b,")))
    urls = (
        table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("form"), "url")
        .unionByName(made("release", F.concat(F.lit("https://github.com/"), "source", F.lit("/Repo.git/releases/tag/v1."), text)))
        .unionByName(made("hub", F.concat(F.lit("https://huggingface.co/"), hub)))
        .unionByName(made("section", F.concat(F.lit("https://github.com/"), section)))
    )
    found = urls.select("id", "form", D.url_identifier(F.col("url")).alias("k")).where("k IS NOT NULL")
    return found.select("id", "form", "k.type", "k.value")


TEXT = "concat_ws(' ', title, summary, body)"
LINKS = f"CAST(json_extract({JSON}, '$.links') AS VARCHAR[])"
SITE = lambda u: f"regexp_extract(regexp_replace(lower(regexp_extract({u}, '{URLRE}', 2)), '^www\\.', ''), '([^.]+\\.[^.]+)$', 1)"
REPO = f"CASE WHEN {js('github_repo')} <> '' THEN {clean_sql('lower(' + js('github_repo') + ')')} END"

IDENTIFIERS = {
    "raw_links": f"SELECT item_id, unnest({LINKS}) AS link, url AS own FROM items WHERE json_array_length({JSON}, '$.links') > 0",
    "cited": f"""SELECT DISTINCT item_id, {identifier_sql('link')} AS k FROM raw_links
      WHERE {SITE('link')} <> {SITE('own')} AND {SITE('link')} NOT IN {_in(D.CHROME_SITES)} AND NOT regexp_matches(link, '{D.CHROME_PATHS}')""",
    "keys": f"""
    SELECT item_id, 'arxiv|' || regexp_replace(trim({js('arxiv_id')}), 'v\\d+$', '') AS k FROM items
    UNION SELECT item_id, 'hf_model|' || lower({js('hf_id')}) FROM items
    UNION SELECT item_id, 'github_repo|' || {REPO} FROM items
    UNION SELECT item_id, 'github_release|' || {REPO} || '@' || {js('tag')} FROM items
    UNION SELECT item_id, {identifier_sql('url')} FROM items
    UNION SELECT item_id, {identifier_sql('o')} FROM (SELECT item_id, {js('outbound_url')} AS o FROM items) x
    UNION SELECT item_id, k FROM cited WHERE item_id IN (SELECT item_id FROM cited WHERE k IS NOT NULL GROUP BY item_id HAVING count(*) <= 3)
    UNION SELECT item_id, 'arxiv|' || unnest(regexp_extract_all({TEXT}, '{AX}', 1)) FROM items
    UNION SELECT item_id, 'arxiv|' || unnest(regexp_extract_all({TEXT}, '(?i)arxiv[:\\s]\\s*(\\d{{4}}\\.\\d{{4,5}})', 1)) FROM items
    UNION SELECT item_id, 'doi|' || rtrim(lower(unnest(regexp_extract_all({TEXT}, '(?i)\\b(10\\.\\d{{4,9}}/[-._;()/:a-z0-9]+)', 1))), '.') FROM items
    UNION SELECT item_id, 'github_repo|' || {clean_sql("lower(regexp_replace(unnest(regexp_extract_all(" + TEXT + ", '" + GH + "', 0)), '(?i)^github\\.com/', ''))")} FROM items""",
    "identifiers": "SELECT item_id, split_part(k, '|', 1) AS type, substring(k, instr(k, '|') + 1) AS value FROM keys WHERE k IS NOT NULL",
}
IDENTIFIERS["identifiers"] = "SELECT DISTINCT item_id, split_part(k, '|', 1) AS type, substring(k, instr(k, '|') + 1) AS value FROM keys WHERE k IS NOT NULL"
STRONG = _in(D.STRONG)


def identifiers(spark, sf):
    return D.extract(spread_relation(spark, sf, "items", "item_id"))


def stored_identifiers(spark, sf):
    """Identifiers as the table they are kept in: extracted once, then read."""
    return cut_lineage(identifiers(spark, sf))


@query("d01_identifiers", "SELECT item_id, type, value FROM identifiers", IDENTIFIERS)
def extraction(spark, sf):
    return identifiers(spark, sf)


@query("d03_cited_links", f"SELECT item_id, split_part(k, '|', 1) AS type, substring(k, instr(k, '|') + 1) AS value FROM cited WHERE k IS NOT NULL AND item_id IN (SELECT item_id FROM cited WHERE k IS NOT NULL GROUP BY item_id HAVING count(*) <= 3)", {k: IDENTIFIERS[k] for k in ("raw_links", "cited")})
def cited(spark, sf):
    from storyloom.functions import items as I

    rows = relation(spark, sf, "items").select("item_id", "url", I.metadata()["links"].alias("links"))
    found = rows.select("item_id", F.explode(D.cited(F.col("url"), F.col("links"))).alias("f"))
    return found.select("item_id", "f.type", "f.value")


@query("d04_pending_enrichment", """
SELECT i.item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM identifiers d WHERE d.item_id = i.item_id AND d.type <> 'url')
AND i.item_id NOT IN (SELECT doc_id FROM @labels WHERE toxic = 1)""", IDENTIFIERS)
def pending(spark, sf):
    # Addresses alone do not count as scanned here, so that some items are pending.
    seen = identifiers(spark, sf).where("type <> 'url'")
    markers = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"))
    return D.pending(relation(spark, sf, "items"), seen, markers).select("item_id")


@query("d05_identifiers_by_type", "SELECT type, count(*) AS n FROM identifiers GROUP BY type", IDENTIFIERS)
def by_type(spark, sf):
    return identifiers(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query("d06_shared_identifiers", f"SELECT type, value, count(DISTINCT item_id) AS items FROM identifiers WHERE type IN {STRONG} GROUP BY type, value HAVING count(DISTINCT item_id) BETWEEN 2 AND 8", IDENTIFIERS)
def shared(spark, sf):
    return D.shared(identifiers(spark, sf))


@query("d07_generic_identifiers", "SELECT type, value, count(*) AS holders FROM identifiers GROUP BY type, value HAVING count(*) > 8", IDENTIFIERS)
def generic(spark, sf):
    return D.generic(identifiers(spark, sf))


@query("d08_identifier_join", f"""
SELECT item_id, parent FROM (
  SELECT a.item_id, b.item_id AS parent, row_number() OVER (PARTITION BY a.item_id ORDER BY ib.at, b.item_id) AS rn
    FROM identifiers a JOIN identifiers b ON b.type = a.type AND b.value = a.value
    JOIN items ia ON ia.item_id = a.item_id JOIN items ib ON ib.item_id = b.item_id
   WHERE a.type IN {STRONG} AND (ib.at, ib.item_id) < (ia.at, ia.item_id)
     AND (a.type, a.value) NOT IN (SELECT (type, value) FROM identifiers GROUP BY type, value HAVING count(*) > 8)) x WHERE rn = 1""", IDENTIFIERS)
def identifier_join(spark, sf):
    items = relation(spark, sf, "items")
    order = items.select("item_id", F.struct(F.lit(1).alias("batch"), "at", "item_id").alias("ord"))
    return D.earliest_sharing(stored_identifiers(spark, sf), order)
