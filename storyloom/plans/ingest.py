"""Ingest, retention and health."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.model import EPOCH_START, NOW, relation, table
from storyloom.operators import ingest as B
from storyloom.plans.registry import query

HASH_SQL = """sha256(concat_ws(chr(0), kind, url, title, coalesce(author, ''), coalesce(strftime(make_timestamp(published_s * 1000000), '%Y-%m-%dT%H:%M:%SZ'), ''),
  coalesce(summary, ''), coalesce(body, ''), coalesce(media_url, '')))"""

# A batch delivers all items again, some of them new, some edited, some twice.
SINCE = EPOCH_START + 20 * 86400
BATCH = {
    "hashed": f"SELECT *, {HASH_SQL} AS content_hash FROM items",
    "stored": "SELECT * FROM hashed WHERE item_id % 10 <> 9",
    "batch": f"""SELECT source, external_id, title, content_hash FROM (
       SELECT source, external_id, title, {HASH_SQL} AS content_hash FROM (SELECT * REPLACE (CASE WHEN item_id % 4 = 1 THEN title || ' (edited)' ELSE title END AS title) FROM items) e) b""",
    "classified": f"""SELECT b.source, b.external_id, b.title, b.content_hash,
       CASE WHEN s.external_id IS NULL AND i.published_s < {SINCE} THEN 'stale' WHEN s.external_id IS NULL THEN 'inserted'
            WHEN s.content_hash = b.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome
       FROM batch b JOIN items i ON i.external_id = b.external_id LEFT JOIN stored s ON s.external_id = b.external_id""",
}


def _stored(spark, sf):
    hashed = relation(spark, sf, "items").withColumn("content_hash", I.content_hash())
    return hashed.where("item_id % 10 <> 9").withColumn("embedded_hash", F.col("content_hash"))


def _batch(spark, sf):
    rows = relation(spark, sf, "items")
    edited = F.when(F.col("item_id") % 4 == 1, F.concat("title", F.lit(" (edited)"))).otherwise(F.col("title"))
    rows = rows.select(*B.IDENTITY, *[c for c in B.CONTENT if c != "title"], "item_id", edited.alias("title"))
    early = rows.where("item_id % 8 = 1").withColumn("title", F.lit("first copy")).withColumn("seq", F.lit(0))
    return rows.withColumn("seq", F.lit(1)).unionByName(early)


def _classified(spark, sf):
    return B.classify(_batch(spark, sf), _stored(spark, sf), NOW, 40)


@query("b01_content_hash", f"SELECT item_id, {HASH_SQL} AS content_hash FROM items")
def content_hash(spark, sf):
    return relation(spark, sf, "items").select("item_id", I.content_hash().alias("content_hash"))


@query("b02_ingest_classification", "SELECT source, external_id, outcome FROM classified", BATCH)
def classification(spark, sf):
    return _classified(spark, sf).select("source", "external_id", "outcome")


@query("b03_upsert", """
SELECT coalesce(s.source, c.source) AS source, coalesce(s.external_id, c.external_id) AS external_id,
       coalesce(c.title, s.title) AS title, coalesce(c.content_hash, s.content_hash) AS content_hash,
       coalesce(s.triage_state, 'pending') AS triage_state, s.triage_score
  FROM stored s FULL OUTER JOIN (SELECT * FROM classified WHERE outcome IN ('inserted', 'updated')) c ON c.external_id = s.external_id""", BATCH)
def upsert(spark, sf):
    return B.upsert(_stored(spark, sf), _classified(spark, sf)).select(
        "source", "external_id", "title", "content_hash", "triage_state", "triage_score"
    )


@query("b04_source_sync", """
SELECT coalesce(s.kind, c.kind) AS kind, coalesce(s.name, c.name) AS name, CASE WHEN c.name IS NOT NULL THEN c.url ELSE s.url END AS url,
       CASE WHEN c.name IS NOT NULL THEN c.enabled WHEN s.origin = 'config' THEN false ELSE s.enabled END AS enabled,
       coalesce(s.origin, 'config') AS origin
FROM sources s FULL OUTER JOIN (SELECT CASE WHEN source_id % 7 = 0 THEN 'arxiv' ELSE kind END AS kind, name, 'https://new/' || name AS url, source_id % 3 <> 1 AS enabled
  FROM sources WHERE source_id % 2 = 0) c ON c.kind = s.kind AND c.name = s.name""")
def source_sync(spark, sf):
    sources = relation(spark, sf, "sources")
    configured = sources.where("source_id % 2 = 0").select(
        F.when(F.col("source_id") % 7 == 0, "arxiv").otherwise(F.col("kind")).alias("kind"), "name",
        F.concat(F.lit("https://new/"), "name").alias("url"), (F.col("source_id") % 3 != 1).alias("enabled"),
    )
    return B.sync_sources(sources, configured)


OUTCOMES = {"outcomes": """SELECT 'src' || (user_id % 20) AS source, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, event_id AS seq,
   CASE WHEN event_type = 'error' THEN 'HTTP ' || user_id END AS error, props AS state FROM @events"""}


@query("b05_fetch_outcome", """
SELECT o.source, max(at_s) AS last_fetched_s, arg_max(struct_pack(e := error), (at_s, seq)).e AS last_error,
       arg_max(struct_pack(e := CASE WHEN error IS NOT NULL THEN at_s END), (at_s, seq)).e AS last_error_s,
       arg_max(state, (at_s, seq)) FILTER (error IS NULL) AS state FROM outcomes o GROUP BY o.source""", OUTCOMES)
def fetch_outcome(spark, sf):
    ev = table(spark, sf, "events")
    outcomes = ev.select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.col("user_id").cast("string"))).alias("error"),
        F.col("props").alias("state"),
    )
    return B.fetch_outcomes(outcomes)


@query("b06_recent_items", """
SELECT i.item_id, i.title, i.triage_state, i.source, s.kind AS source_kind, i.at FROM items i JOIN sources s ON s.name = i.source
WHERE i.triage_state = 'kept' ORDER BY i.at DESC, i.item_id LIMIT 50""")
def recent(spark, sf):
    return B.recent(relation(spark, sf, "items"), relation(spark, sf, "sources"), 50, "kept").select(
        "item_id", "title", "triage_state", "source", "source_kind", "at"
    )


@query("b07_source_health", """
SELECT s.kind, s.name, s.enabled, s.last_error, count(i.item_id) AS item_count, max(i.at) AS newest
FROM sources s LEFT JOIN items i ON i.source = s.name GROUP BY ALL""")
def health(spark, sf):
    return B.source_health(relation(spark, sf, "items"), relation(spark, sf, "sources"))


@query("b08_broken_sources", "SELECT name, last_error FROM sources WHERE enabled AND last_error IS NOT NULL")
def broken(spark, sf):
    return B.broken(relation(spark, sf, "sources"))


RETAIN = 25
CUT = (NOW - RETAIN * 86400) // 86400
PRUNED = {
    "gone": f"""SELECT item_id FROM items i WHERE floor(i.at / 86400) < {CUT} AND NOT EXISTS (
      SELECT 1 FROM story_items si JOIN interactions x ON x.story_id = si.story_id AND x.action = 'saved' WHERE si.item_id = i.item_id)""",
    "left_items": "SELECT * FROM story_items WHERE item_id NOT IN (SELECT item_id FROM gone)",
}


@query("b09_prune", """
SELECT 'items' AS part, item_id AS id FROM items WHERE item_id NOT IN (SELECT item_id FROM gone)
UNION ALL SELECT 'vectors', item_id FROM vectors WHERE item_id IN (SELECT item_id FROM items) AND item_id NOT IN (SELECT item_id FROM gone)
UNION ALL SELECT 'stories', story_id FROM stories WHERE story_id IN (SELECT story_id FROM left_items)""", PRUNED)
def prune(spark, sf):
    rel = lambda n: relation(spark, sf, n)
    after = B.prune(rel("items"), rel("vectors"), rel("story_items"), rel("stories"), rel("interactions"), NOW, RETAIN)
    parts = [after[p].select(F.lit(p).alias("part"), F.col(k).alias("id"))
             for p, k in (("items", "item_id"), ("vectors", "item_id"), ("stories", "story_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b10_prune_preview", "SELECT count(*) AS doomed FROM gone", PRUNED)
def prune_preview(spark, sf):
    rel = lambda n: relation(spark, sf, n)
    return B.doomed(rel("items"), rel("story_items"), rel("interactions"), NOW, RETAIN).agg(F.count("*").alias("doomed"))


@query("b11_run_totals", """
SELECT source, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated,
 count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'stale') AS stale FROM classified GROUP BY source""", BATCH)
def run_totals(spark, sf):
    return B.totals(_classified(spark, sf))


@query("b12_reconcile_sources", """
SELECT name, origin, CASE WHEN origin = 'reader' THEN EXISTS (SELECT 1 FROM reader_topic_sources r WHERE r.source = s.name) ELSE enabled END AS enabled
FROM sources s""")
def reconcile(spark, sf):
    return B.reconcile(relation(spark, sf, "sources"), relation(spark, sf, "reader_topic_sources"))


@query("b13_status", """
SELECT 'kept' AS measure, count(*) AS value FROM items WHERE triage_state = 'kept'
UNION ALL SELECT 'rejected', count(*) FROM items WHERE triage_state = 'rejected'
UNION ALL SELECT 'pending', count(*) FROM items WHERE triage_state = 'pending'
UNION ALL SELECT 'newest_item', max(i.at) FROM items i
UNION ALL SELECT 'stories', count(*) FROM stories
UNION ALL SELECT 'labelled', count(DISTINCT story_id) FROM story_topics
UNION ALL SELECT 'failing_sources', count(*) FROM sources WHERE enabled AND last_error IS NOT NULL
UNION ALL SELECT 'last_fetch', max(last_fetched_s) FROM sources""")
def status(spark, sf):
    return B.status(*[relation(spark, sf, n) for n in ("items", "stories", "story_topics", "sources")])


SETTINGS = {"threshold": 0.62, "interests": ["a", "b"], "exclude": [], "always_keep": ["gpt"], "always_drop": []}
CANONICAL = json.dumps(SETTINGS, sort_keys=True)


@query("b14_profile_change", f"""
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'pending' ELSE triage_state END AS triage_state,
       CASE WHEN item_id % 3 = 0 THEN NULL ELSE triage_score END AS triage_score, substring(sha256('{CANONICAL}'), 1, 16) AS fingerprint
FROM items""")
def profile_change(spark, sf):
    current = B.fingerprint(SETTINGS)
    older = B.fingerprint({**SETTINGS, "threshold": 0.6})
    items = relation(spark, sf, "items").withColumn(
        "fingerprint", F.when(F.col("item_id") % 3 == 0, F.lit(older)).otherwise(F.lit(current))
    )
    return B.reopen_changed(items, current)
