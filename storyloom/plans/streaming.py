"""Streaming forms, run over the tables' files until all is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.model import NOW, relation, table
from storyloom.operators import ingest as B
from storyloom.plans.feed import AGG
from storyloom.plans.identity import stored_identifiers
from storyloom.plans.ingest import HASH_SQL
from storyloom.plans.readers import IMPRESSIONS, impressions
from storyloom.plans.registry import query
from storyloom.plans.similarity import DAYS, LOW, MERGE, _cluster_sql
from storyloom.streaming import jobs as J


def _items_of(spark, sf, stream):
    """Item rows of arriving documents, in the shape a delivery has."""
    items = relation(spark, sf, "items").select("item_id", *B.IDENTITY, *B.CONTENT, "at")
    return stream.select(F.col("doc_id").alias("item_id")).join(items, "item_id")


@query("i01_source_offsets", f"SELECT item_id, {HASH_SQL} AS content_hash FROM items")
def source_offsets(spark, sf):
    checkpoint, out = J.scratch_pair(spark, "i01")
    rows = J.hashed_items(_items_of(spark, sf, J.stream_of(spark, sf, "documents"))).select("item_id", "content_hash")
    # The second run starts from the offsets of the first and finds nothing new.
    for _ in range(2):
        J.drain(rows, checkpoint, out)
    return spark.read.parquet(out)


@query("i02_idempotent_upsert", f"SELECT source, external_id, {HASH_SQL} AS content_hash, 'pending' AS triage_state FROM items WHERE published_s IS NULL OR published_s >= {NOW - 45 * 86400}")
def idempotent_upsert(spark, sf):
    checkpoint, out = J.scratch_pair(spark, "i02")
    store = J.Versions(spark, out)
    # The same deliveries arrive twice, through two streams with their own offsets.
    for run in range(2):
        rows = _items_of(spark, sf, J.stream_of(spark, sf, "documents")).withColumn("seq", F.lit(run))
        J.ingest_stream(rows, store, f"{checkpoint}-{run}", NOW, 45, first=run * 1000)
    return store.before().select(*B.IDENTITY, "content_hash", "triage_state")


@query("i03_late_items", f"""
SELECT CASE WHEN item_id % 3 = 0 THEN 'known' WHEN coalesce(published_s < {NOW - 40 * 86400}, false) THEN 'stale' ELSE 'inserted' END AS outcome, count(*) AS n FROM items GROUP BY 1""")
def late_items(spark, sf):
    checkpoint, out = J.scratch_pair(spark, "i03")
    stored = relation(spark, sf, "items").where("item_id % 3 = 0")
    sink = J.Versions(spark, out)
    J.outcome_counts(_items_of(spark, sf, J.stream_of(spark, sf, "documents")), stored, NOW, 40, sink, checkpoint)
    return sink.before()


@query("i04_cluster_stream", "SELECT item_id, story_id, how FROM assigned", _cluster_sql(MERGE))
def cluster_stream(spark, sf):
    checkpoint, out = J.scratch_pair(spark, "i04")
    times = relation(spark, sf, "items").select("item_id", "at")
    arrivals = J.stream_of(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding").join(times, "item_id")
    store = J.Versions(spark, out)
    J.cluster_stream(arrivals, stored_identifiers(spark, sf), store, checkpoint, MERGE, LOW, DAYS)
    return store.before().select("item_id", "story_id", "how")


@query("i05_read_mark_stream", """
SELECT DISTINCT s.reader, s.story_id FROM impressions s WHERE s.action = 'shown' AND EXISTS (SELECT 1 FROM impressions p WHERE p.reader = s.reader AND p.seq > s.seq
  AND (p.action = 'end' OR (p.action = 'passed' AND p.story_id = s.story_id)))""", IMPRESSIONS)
def read_mark_stream(spark, sf):
    checkpoint, out = J.scratch_pair(spark, "i05")
    J.read_mark_stream(impressions(J.stream_of(spark, sf, "events")), out, checkpoint)
    return spark.read.schema("reader long, story_id long").parquet(out)


@query("i06_story_wake", "SELECT story_id, item_count, source_count, newest, origin FROM agg", AGG)
def story_wake(spark, sf):
    checkpoint, out = J.scratch_pair(spark, "i06")
    store = J.Versions(spark, out)
    members, items, stories = [relation(spark, sf, n) for n in ("story_items", "items", "stories")]
    J.wake_stream(J.stream_of(spark, sf, "documents").select(F.col("doc_id").alias("item_id")), members, items, stories, store, checkpoint)
    return store.before().select("story_id", "item_count", "source_count", "newest", "origin")
