"""The relations of the engine, mapped onto the driver's tables.

Each relation is one SQL text both Spark and an ANSI engine accept, so the
mapping (not the operators) is shared between a query and its check. ``@name``
stands for a base table. Times are epoch seconds, the clock of an item being
``at = coalesce(published_s, fetched_s)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from storyloom.session import spread

# 2024-01-01T00:00:00Z, and the moment queries treat as "now": nothing reads a clock.
EPOCH_START = 1704067200
CORPUS_DAYS = 60
NOW = EPOCH_START + CORPUS_DAYS * 86400

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

ITEM_KINDS = ("paper", "article", "model", "repo", "discussion", "post", "video")

# Twelve consecutive items lie within a day of each other; the groups are spread
# over the corpus days at any scale.
SPREAD = f"(CAST(floor(d.doc_id / 12) AS BIGINT) * 2654437 + (d.doc_id % 12) * 7919) % {CORPUS_DAYS * 86400}"

RELATIONS: dict[str, str] = {}

RELATIONS["items"] = f"""
SELECT d.doc_id AS item_id, d.source AS source, 'doc-' || CAST(d.doc_id AS STRING) AS external_id,
       d.lang AS lang,
       CASE d.doc_id % 7 WHEN 0 THEN 'paper' WHEN 1 THEN 'article' WHEN 2 THEN 'model' WHEN 3 THEN 'repo'
            WHEN 4 THEN 'discussion' WHEN 5 THEN 'post' ELSE 'video' END AS kind,
       CASE WHEN d.doc_id % 5 = 0
            THEN 'http://www.site' || CAST(d.doc_id % 7 AS STRING) || '.example.com/' || d.lang || '/'
                 || CAST(d.doc_id AS STRING) || '/?utm_source=feed&b=2&a=1#top'
            ELSE 'https://site' || CAST(CAST(floor(d.doc_id / 20) AS BIGINT) % 7 AS STRING) || '.example.org/story/'
                 || CAST(CASE WHEN d.doc_id % 10 = 3 THEN d.doc_id - 1 ELSE d.doc_id END AS STRING) END AS url,
       CASE WHEN d.doc_id % 13 = 0
            THEN split_part(d.text, chr(10), 1) || ' (arXiv:2401.' || substring(CAST(100000 + CAST(floor(d.doc_id / 20) AS BIGINT) % 100000 AS STRING), 2) || ')'
            ELSE split_part(d.text, chr(10), 1) END AS title,
       CASE WHEN d.doc_id % 9 = 0 OR instr(d.text, chr(10)) = 0 THEN NULL
            WHEN d.doc_id % 19 = 0 THEN substring(d.text, instr(d.text, chr(10)) + 1) || ' See https://github.com/Src/Repo' || CAST(d.doc_id % 3 AS STRING) || '.git.'
            ELSE substring(d.text, instr(d.text, chr(10)) + 1) END AS summary,
       CASE WHEN d.doc_id % 7 = 3 THEN d.text ELSE NULL END AS body,
       CASE WHEN d.doc_id % 4 = 0 THEN 'https://img.example.net/' || CAST(d.doc_id AS STRING) || '.jpg' ELSE NULL END AS media_url,
       CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE 'author-' || CAST(d.doc_id % 40 AS STRING) END AS author,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE {EPOCH_START} + {SPREAD} END AS published_s,
       {EPOCH_START} + {SPREAD} + 900 AS fetched_s,
       CASE WHEN d.doc_id % 11 = 0 THEN 900 ELSE 0 END + {EPOCH_START} + {SPREAD} AS at,
       CASE d.doc_id % 7
         WHEN 0 THEN chr(123) || '"arxiv_id":"2401.' || substring(CAST(100000 + CAST(floor(d.doc_id / 20) AS BIGINT) % 100000 AS STRING), 2) || 'v2","upvotes":' || CAST(d.n_chars % 90 AS STRING) || chr(125)
         WHEN 1 THEN chr(123) || '"feed":"' || d.source || '","links":["https://arxiv.org/abs/2401.' || substring(CAST(100000 + CAST(floor(d.doc_id / 20) AS BIGINT) % 100000 AS STRING), 2) || '","https://x.com/share?u=1"]' || chr(125)
         WHEN 2 THEN chr(123) || '"hf_id":"Org/M' || CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING) || '","likes":' || CAST(d.n_chars % 70 AS STRING) || ',"pipeline_tag":"text-generation","tags":["arxiv:2401.00001","license:mit","' || d.lang || '","demo"]' || chr(125)
         WHEN 3 THEN chr(123) || '"github_repo":"Src/Repo' || CAST(d.doc_id % 3 AS STRING) || '","tag":"v1.' || CAST(CAST(floor(d.doc_id / 50) AS BIGINT) AS STRING) || '"' || chr(125)
         WHEN 4 THEN chr(123) || '"outbound_url":"https://' || CASE WHEN d.doc_id % 3 = 0 THEN 'arxiv.org/pdf/2401.99999' ELSE 'www.site' || CAST(d.doc_id % 5 AS STRING) || '.example.com/en/' || CAST(d.doc_id - 4 AS STRING) END || '","points":' || CAST(d.n_chars % 500 AS STRING) || ',"num_comments":' || CAST(d.n_chars % 30 AS STRING) || chr(125)
         WHEN 5 THEN 'not json'
         ELSE NULL END AS metadata,
       CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 AND l.toxic = 0 THEN 'kept' ELSE 'rejected' END AS triage_state,
       CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(50 + d.n_chars % 50 AS DOUBLE) / 100 END AS triage_score,
       d.n_chars AS n_chars
  FROM @documents d LEFT JOIN @labels l ON l.doc_id = d.doc_id
"""

# The vectors of items; item and vector ids are the same key.
RELATIONS["vectors"] = "SELECT vec_id AS item_id, embedding, label FROM @embeddings"

RELATIONS["sources"] = f"""
SELECT s.source AS name, CAST(substring(s.source, 4) AS BIGINT) AS source_id,
       CASE CAST(substring(s.source, 4) AS BIGINT) % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'hn' ELSE 'sitemap' END AS kind,
       'https://' || s.source || '.example.com/feed' AS url,
       CASE WHEN CAST(substring(s.source, 4) AS BIGINT) % 5 = 4 THEN 'reader' ELSE 'config' END AS origin,
       CAST(substring(s.source, 4) AS BIGINT) % 4 <> 3 AS enabled,
       CASE WHEN CAST(substring(s.source, 4) AS BIGINT) % 6 = 1 THEN 'HTTP 403' ELSE NULL END AS last_error,
       {EPOCH_START} + CAST(substring(s.source, 4) AS BIGINT) * 3600 AS last_fetched_s
  FROM (SELECT DISTINCT source FROM @documents) s
"""

# Stories of six, three and one items; the smallest id opens the story.
RELATIONS["story_items"] = """
SELECT m.story_id, m.item_id,
       CASE WHEN m.item_id = m.story_id
            THEN CASE m.kind WHEN 'paper' THEN 'paper' WHEN 'repo' THEN 'code' WHEN 'video' THEN 'video' WHEN 'discussion' THEN 'discussion' ELSE 'seed' END
            ELSE CASE m.kind WHEN 'paper' THEN 'paper' WHEN 'repo' THEN 'code' WHEN 'model' THEN 'code' WHEN 'video' THEN 'video' WHEN 'discussion' THEN 'discussion' ELSE 'coverage' END
       END AS role
  FROM (SELECT item_id, kind,
               CASE WHEN item_id % 12 < 6 THEN item_id - item_id % 12
                    WHEN item_id % 12 < 9 THEN item_id - item_id % 12 + 6 ELSE item_id END AS story_id
          FROM items) m
"""

RELATIONS["stories"] = """
SELECT si.story_id, CASE WHEN si.story_id % 36 = 0 THEN 'Synthesis ' || CAST(si.story_id AS STRING) ELSE NULL END AS title,
       CAST(NULL AS STRING) AS summary, max(i.at) AS last_activity, min(i.at) AS first_seen
  FROM story_items si JOIN items i ON i.item_id = si.item_id GROUP BY si.story_id
"""

# Reader activity as events on stories.
RELATIONS["interactions"] = """
SELECT event_id, user_id AS reader, CAST(substring(props, 7, length(props) - 7) AS BIGINT) * 12 AS story_id,
       CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'opened' WHEN 'purchase' THEN 'saved' ELSE 'dismissed' END AS action,
       CAST(ts AS TIMESTAMP) AS at
  FROM @events WHERE event_type <> 'signup'
"""

# A tree of regions, nations and ten scored leaves.
RELATIONS["spine"] = """
SELECT 'region-' || CAST(r_regionkey AS STRING) AS slug, r_name AS name, CAST(NULL AS STRING) AS parent, CAST(r_regionkey AS BIGINT) AS ord,
       CASE r_regionkey WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE NULL END AS keep_days,
       CASE r_regionkey WHEN 0 THEN 2 WHEN 3 THEN 4 ELSE NULL END AS keep_most, 'about ' || r_name AS description
  FROM @region
UNION ALL
SELECT 'nation-' || CAST(n_nationkey AS STRING), n_name, 'region-' || CAST(n_regionkey AS STRING), 100 + CAST(n_nationkey AS BIGINT),
       CASE n_nationkey % 4 WHEN 0 THEN 20 ELSE NULL END, CASE n_nationkey % 3 WHEN 0 THEN 5 ELSE NULL END, 'about ' || n_name
  FROM @nation
UNION ALL
SELECT 'leaf-' || CAST(label AS STRING), 'Leaf ' || CAST(label AS STRING),
       CASE WHEN label < 5 THEN 'region-' || CAST(label AS STRING) ELSE 'nation-' || CAST(label AS STRING) END, 1000 + CAST(label AS BIGINT),
       CASE label WHEN 7 THEN 10 ELSE NULL END, CASE label WHEN 8 THEN 0 ELSE NULL END, 'about leaf ' || CAST(label AS STRING)
  FROM (SELECT DISTINCT label FROM @embeddings) x
"""

# Where each story is filed: a leaf, a nation or nothing.
RELATIONS["story_topics"] = """
SELECT story_id, CASE WHEN story_id % 5 < 3 THEN 'leaf-' || CAST(CAST(floor(story_id / 3) AS BIGINT) % 10 AS STRING)
                      ELSE 'nation-' || CAST(CAST(floor(story_id / 3) AS BIGINT) % 25 AS STRING) END AS slug
  FROM stories WHERE story_id % 7 <> 0
"""

# One topic per reader and event kind they used most plainly: the profile rows.
RELATIONS["reader_topics"] = """
SELECT c_custkey AS reader, 'topic-' || CAST(c_custkey AS STRING) || '-' || CAST(c_nationkey AS STRING) AS topic_key,
       CASE WHEN c_custkey % 3 = 0 THEN 'nation-' || CAST(c_nationkey AS STRING) ELSE NULL END AS spine,
       CASE WHEN c_custkey % 3 = 0 THEN 'Place ' || CAST(c_nationkey AS STRING)
            WHEN c_custkey % 2 = 0 THEN 'the ' || lower(substring(c_mktsegment, 1, 2)) || ' of Ere' ELSE 'est of the der' END AS name,
       CASE WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN CAST(floor(c_custkey / 12) AS BIGINT) * 12 ELSE NULL END AS example,
       CASE WHEN c_custkey % 4 = 1 THEN 'leaux' ELSE NULL END AS muted,
       c_custkey * 31 % 997 AS reader_rank
  FROM @customer
"""

# Profiles of many topics each, for the topic graph: twenty readers who share out the topics above.
RELATIONS["graph_topics"] = """
SELECT reader % 20 AS reader, topic_key, spine, name, reader AS taken_from FROM reader_topics
"""

# The stories a topic was taught by, and the words its reader does not want: as many as there are.
RELATIONS["topic_examples"] = """
SELECT topic_key, example FROM reader_topics WHERE example IS NOT NULL
UNION ALL SELECT topic_key, example + 12 FROM reader_topics WHERE example IS NOT NULL AND reader % 4 = 0
"""
RELATIONS["topic_muted"] = """
SELECT topic_key, muted AS word FROM reader_topics WHERE muted IS NOT NULL
UNION ALL SELECT topic_key, 'Of' FROM reader_topics WHERE reader % 5 = 1
"""

# The four sources each reader topic takes.
RELATIONS["reader_topic_sources"] = """
SELECT x.topic_key, s.name AS source FROM (
    SELECT topic_key, reader % 20 AS source_id FROM reader_topics UNION ALL SELECT topic_key, (reader + 1) % 20 FROM reader_topics
    UNION ALL SELECT topic_key, (reader + 7) % 20 FROM reader_topics UNION ALL SELECT topic_key, (reader + 12) % 20 FROM reader_topics
  ) x JOIN sources s ON s.source_id = x.source_id
"""

METADATA = T.StructType([
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("hf_id", T.StringType()),
    T.StructField("hf_dataset", T.StringType()),
    T.StructField("github_repo", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("outbound_url", T.StringType()),
    T.StructField("feed", T.StringType()),
    T.StructField("pipeline_tag", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("points", T.LongType()),
    T.StructField("upvotes", T.LongType()),
    T.StructField("likes", T.LongType()),
    T.StructField("num_comments", T.LongType()),
])


def _needed(text: str) -> list[str]:
    """Relations ``text`` names, with those they name, in definition order."""
    wanted: set[str] = set()
    queue = [text]
    while queue:
        body = queue.pop()
        for name in RELATIONS:
            if name not in wanted and re.search(rf"(?<![@\w.]){name}\b(?!\s*\()", body):
                wanted.add(name)
                queue.append(RELATIONS[name])
    return [name for name in RELATIONS if name in wanted]


def with_relations(text: str, extra: dict[str, str] | None = None) -> str:
    """``text`` as one statement with every relation it names defined before it."""
    extra = extra or {}
    everything = text + " ".join(extra.values())
    parts = [f"{name} AS ({RELATIONS[name]})" for name in _needed(everything)]
    parts += [f"{name} AS MATERIALIZED ({body})" for name, body in extra.items()]
    if not parts:
        return text
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A mapping text over base tables and relations as a DataFrame."""
    parts = [f"{n} AS ({RELATIONS[n]})" for n in _needed(text)]
    text = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + text
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", text))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A mapped relation as a DataFrame."""
    return mapped(spark, sf_dir, RELATIONS[name])


def spread_relation(spark: SparkSession, sf_dir: str, name: str, key: str, base: str = "documents") -> DataFrame:
    """A relation on every core, where its base table has too few files for that."""
    return spread(relation(spark, sf_dir, name), key, len(table(spark, sf_dir, base).inputFiles()))


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return spread(df, key, len(df.inputFiles()))
