"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # solver threads beside the JVM wait for each other
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a01_feed_entries", "a13_head_metadata", "a19_describe_apply",
    "b02_ingest_classification", "b03_upsert", "b07_source_health", "b09_prune",
    "c01_strip_html", "c04_canonical_url", "c09_embedding_text",
    "d01_identifiers", "d06_shared_identifiers", "d08_identifier_join",
    "e02_embed_job", "e05_triage_decision", "e12_best_match_in_window", "e13_story_clustering", "e24_threshold_trade_off",
    "f01_story_centroids", "f08_topic_assignment", "f12_topic_stats", "f18_facet_matches", "f21_entity_matches", "f25_name_mining",
    "g01_story_aggregates", "g03_ranked_feed", "g05_diversified_feed", "g07_story_cards", "g11_renewal", "g13_newest_per_topic",
    "h01_topic_membership", "h11_source_catalogue", "h16_subject_sources", "h18_read_marks", "h20_related_topics",
    "i05_read_mark_stream",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from storyloom.plans import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("storyloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for starting Python workers and the JVM's compiler.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
