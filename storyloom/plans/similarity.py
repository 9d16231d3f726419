"""Embedding, triage, clustering and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import embed as M
from storyloom.functions import items as I
from storyloom.functions import vectors as V
from storyloom.model import relation, spread_table, table
from storyloom.operators import calibrate as K
from storyloom.operators import cluster as C
from storyloom.operators import similarity as S
from storyloom.operators import triage as E
from storyloom.plans.identity import IDENTIFIERS, STRONG, stored_identifiers
from storyloom.plans.registry import query
from storyloom.plans.scalars import EMBED_SQL

# Thresholds for the driver's vectors, which lie far apart from each other.
MERGE, LOW, DAYS = 0.34, 0.28, 14
KEEP, DROP = ["ere", "tion "], ["leaux", "sch"]
TRIAGE_AT = 0.2


def reference_vectors(spark, sf, key, condition="true"):
    """(key, vector): mean directions of the vectors by a key of their label, stand-ins for embedded prose."""
    rows = table(spark, sf, "embeddings").where(condition).withColumn("key", F.expr(key))
    return V.mean_direction(rows, ["key"], out="vector")


def means_sql(key: str, condition: str = "true", source: str = "@embeddings") -> str:
    """(key, vec): normalised mean vectors, in SQL."""
    return f"""SELECT key, list(m / CASE WHEN n = 0 THEN 1 ELSE n END ORDER BY pos) AS vec FROM (
      SELECT key, pos, m, sqrt(sum(m * m) OVER (PARTITION BY key)) AS n FROM (
        SELECT key, pos, avg(v) AS m FROM (SELECT {key} AS key, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM {source} WHERE {condition}) a GROUP BY key, pos) b) c GROUP BY key"""


def _interests(spark, sf):
    return reference_vectors(spark, sf, "label", "label < 7"), reference_vectors(spark, sf, "label", "label >= 7")


def _scored(spark, sf):
    return E.score(relation(spark, sf, "vectors"), *_interests(spark, sf))


PROFILE = {
    "interest": means_sql("label", "label < 7"),
    "unwanted": means_sql("label", "label >= 7"),
    "dots": "SELECT v.item_id, i.key, list_dot_product(v.embedding::DOUBLE[], i.vec) AS s FROM vectors v, interest i",
    "scored": """SELECT d.item_id, max(s) AS score, arg_max(key, (s, -key)) AS best, x.against AS exclude_score
       FROM dots d JOIN (SELECT v.item_id, max(list_dot_product(v.embedding::DOUBLE[], u.vec)) AS against FROM vectors v, unwanted u GROUP BY v.item_id) x
       ON x.item_id = d.item_id GROUP BY d.item_id, x.against""",
    "decided": f"""SELECT i.item_id, CASE WHEN contains(lower(i.title), 'leaux') THEN 'rejected|always_drop: leaux' WHEN contains(lower(i.title), 'sch') THEN 'rejected|always_drop: sch'
       WHEN contains(lower(i.title), 'ere') THEN 'kept|always_keep: ere' WHEN contains(lower(i.title), 'tion ') THEN 'kept|always_keep: tion '
       WHEN exclude_score > score THEN printf('rejected|closer to excluded (%.3f)', exclude_score)
       WHEN score >= {TRIAGE_AT} THEN printf('kept|similarity %.3f', score) ELSE printf('rejected|below threshold (%.3f)', score) END AS d, score
       FROM items i JOIN scored s ON s.item_id = i.item_id""",
}


def _decided(spark, sf):
    rows = relation(spark, sf, "items").select("item_id", "title").join(_scored(spark, sf), "item_id")
    d = E.decision(F.col("title"), F.col("score"), F.col("exclude_score"), TRIAGE_AT, KEEP, DROP)
    return rows.withColumn("d", d).select("item_id", "d.state", "d.reason", "score")


HASHES = "CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE external_id END"


@query("e01_pending_embeddings", f"SELECT i.item_id, i.at FROM items i WHERE {HASHES} IS NULL OR {HASHES} <> external_id")
def pending_embeddings(spark, sf):
    items = relation(spark, sf, "items").withColumn("embedded_hash", F.expr(HASHES))
    return items.where(~F.col("embedded_hash").eqNullSafe(F.col("external_id"))).select("item_id", "at").orderBy(F.desc("at"))


@query("e02_embed_job", """
SELECT doc_id AS item_id, dim, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 6) AS value FROM (
  SELECT doc_id, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS w FROM @documents) a GROUP BY doc_id, dim) b""")
def embed_job(spark, sf):
    rows = spread_table(spark, sf, "documents", "doc_id").select(F.col("doc_id").alias("item_id"), M.embedded(F.col("text"), M.hashed_terms()).alias("v"))
    each = rows.select("item_id", F.posexplode("v").alias("dim", "value")).where("value <> 0")
    return each.select("item_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("e02_embed_pending", f"""
SELECT item_id, external_id AS content_hash, 'hashed' AS model, dim, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY item_id, external_id)) AS FLOAT) AS DOUBLE), 6) AS value FROM (
  SELECT item_id, external_id, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n FROM (
    SELECT item_id, external_id, unnest(regexp_extract_all(lower({EMBED_SQL}), '[\\pL\\pN]+')) AS w FROM items WHERE item_id % 4 <= 1) a GROUP BY item_id, external_id, dim) b
UNION ALL SELECT item_id, external_id, 'hashed', 0, 1.0 FROM items WHERE item_id % 4 > 1""")
def embed_pending(spark, sf):
    items = relation(spark, sf, "items").withColumn("content_hash", F.col("external_id"))
    stored = items.withColumn("embedded_hash", F.expr(HASHES)).where("embedded_hash IS NOT NULL").select(
        "item_id", F.col("embedded_hash").alias("content_hash"), F.lit("hashed").alias("model"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    rows = M.embed_pending(items, stored, "hashed", M.hashed_terms())
    each = rows.select("item_id", "content_hash", "model", F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return each.withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("e03_model_guard", "SELECT CAST(len(embedding) AS INTEGER) AS dimension, count(*) AS vectors FROM @embeddings GROUP BY 1")
def model_guard(spark, sf):
    return M.single_model(table(spark, sf, "embeddings"))


@query("e04_profile_scoring", "SELECT item_id, round(score, 6) AS score, best, round(exclude_score, 6) AS exclude_score FROM scored", PROFILE)
def profile_scoring(spark, sf):
    return _scored(spark, sf).select("item_id", F.round("score", 6).alias("score"), "best", F.round("exclude_score", 6).alias("exclude_score"))


@query("e05_triage_decision", "SELECT item_id, split_part(d, '|', 1) AS state, substring(d, instr(d, '|') + 1) AS reason, round(score, 6) AS score FROM decided", PROFILE)
def triage_decision(spark, sf):
    return _decided(spark, sf).withColumn("score", F.round("score", 6))


@query("e06_triage_totals", """
SELECT split_part(d, '|', 1) AS outcome, count(*) AS n FROM decided GROUP BY 1
UNION ALL SELECT 'skipped', count(*) FROM items WHERE triage_state = 'pending' AND item_id NOT IN (SELECT item_id FROM decided)""", PROFILE)
def triage_totals(spark, sf):
    return E.totals(relation(spark, sf, "items"), _decided(spark, sf))


@query("e07_triage_explain", """
SELECT item_id, place, key AS interest, round(s, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, key) AS INTEGER) AS place FROM dots) x WHERE place <= 5""", PROFILE)
def triage_explain(spark, sf):
    return E.best_of(_scored(spark, sf)).withColumn("score", F.round("score", 6))


@query("e08_triage_stats", "SELECT triage_state, count(*) AS n FROM items GROUP BY 1")
def triage_stats(spark, sf):
    return E.stats(relation(spark, sf, "items"))


@query("e09_keep_rate_by_source", """
SELECT source, count(*) AS total, count(*) FILTER (triage_state = 'kept') AS kept, round(avg(triage_score), 6) AS mean_score,
       round(count(*) FILTER (triage_state = 'kept') / count(*), 6) AS rate FROM items WHERE triage_score IS NOT NULL GROUP BY source""")
def keep_rate(spark, sf):
    return E.by_source(relation(spark, sf, "items")).withColumn("mean_score", F.round("mean_score", 6)).withColumn("rate", F.round("rate", 6))


@query("e10_margin_sample", """
SELECT item_id, triage_state, triage_score FROM (SELECT *, row_number() OVER (PARTITION BY triage_state ORDER BY CASE triage_state WHEN 'kept' THEN triage_score ELSE -triage_score END, item_id) AS rn
  FROM items WHERE triage_score IS NOT NULL AND triage_state <> 'pending') x WHERE rn <= 20""")
def margin_sample(spark, sf):
    return E.margin_sample(relation(spark, sf, "items"))


@query("e11_unclustered_items", """
SELECT i.item_id, i.at FROM items i JOIN vectors v ON v.item_id = i.item_id WHERE NOT EXISTS (SELECT 1 FROM story_items s WHERE s.item_id = i.item_id AND s.role <> 'coverage')""")
def unclustered(spark, sf):
    stored = relation(spark, sf, "story_items").where("role <> 'coverage'")
    return C.unclustered(relation(spark, sf, "items"), relation(spark, sf, "vectors"), stored).select("item_id", "at")


def members(spark, sf, stored: str = "false"):
    items = relation(spark, sf, "items").select("item_id", "at")
    rows = items.join(relation(spark, sf, "vectors").select("item_id", "embedding"), "item_id")
    return rows.withColumn("batch", F.when(F.expr(stored), 0).otherwise(1))


def _cluster_sql(merge: float, stored: str = "false") -> dict[str, str]:
    return {
        **IDENTIFIERS,
        "m": f"SELECT i.item_id, i.at AS t, CASE WHEN {stored.replace('item_id', 'i.item_id')} THEN 0 ELSE 1 END AS batch, v.embedding::DOUBLE[] AS e FROM items i JOIN vectors v ON v.item_id = i.item_id",
        "wide": "SELECT type, value FROM identifiers GROUP BY type, value HAVING count(*) > 8",
        "usable": f"SELECT d.* FROM identifiers d ANTI JOIN wide w ON w.type = d.type AND w.value = d.value WHERE d.type IN {STRONG}",
        "by_key": """SELECT item_id, parent FROM (SELECT a.item_id, b.item_id AS parent, row_number() OVER (PARTITION BY a.item_id ORDER BY mb.batch, mb.t, b.item_id) AS rn
           FROM usable a JOIN usable b ON b.type = a.type AND b.value = a.value JOIN m ma ON ma.item_id = a.item_id JOIN m mb ON mb.item_id = b.item_id
          WHERE (mb.batch, mb.t, b.item_id) < (ma.batch, ma.t, a.item_id)) x WHERE rn = 1""",
        "pairs": f"""SELECT a.item_id, b.item_id AS match, b.batch AS b_batch, b.t AS b_t, list_dot_product(a.e, b.e) AS score FROM m a JOIN m b
           ON (b.batch, b.t, b.item_id) < (a.batch, a.t, a.item_id) AND abs(a.t - b.t) <= {DAYS * 86400} WHERE a.batch = 1""",
        "nearest": f"""SELECT item_id, match, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, b_batch, b_t, match) AS rn FROM pairs) x WHERE rn = 1 AND score >= {LOW}""",
        "parents": f"""SELECT m.item_id, k.parent AS key_parent, CASE WHEN k.parent IS NULL THEN n.match END AS near, CASE WHEN k.parent IS NULL THEN n.score END AS score,
           coalesce(k.parent, CASE WHEN n.score >= {merge} THEN n.match END, m.item_id) AS parent
           FROM m LEFT JOIN by_key k ON k.item_id = m.item_id LEFT JOIN nearest n ON n.item_id = m.item_id WHERE m.batch = 1""",
        "linked": "SELECT item_id, parent FROM parents UNION ALL SELECT item_id, item_id FROM m WHERE batch = 0",
        "climbed": """WITH RECURSIVE up AS (SELECT item_id, parent AS root FROM linked UNION ALL
           SELECT u.item_id, p.parent FROM up u JOIN linked p ON p.item_id = u.root AND p.parent <> p.item_id) SELECT * FROM up""",
        "assigned": f"""SELECT p.item_id, u.root AS story_id, CASE WHEN key_parent IS NOT NULL THEN 'identifier' WHEN score >= {merge} THEN 'similarity' WHEN score >= {LOW} THEN 'ambiguous' ELSE 'new' END AS how,
           near AS nearest, round(score, 6) AS score FROM parents p JOIN climbed u ON u.item_id = p.item_id JOIN linked r ON r.item_id = u.root AND r.parent = r.item_id""",
    }


def assigned(spark, sf, merge=MERGE, stored: str = "false"):
    rows = members(spark, sf, stored)
    known = rows.where("batch = 0").select("item_id", F.col("item_id").alias("story_id")) if stored != "false" else None
    return C.assign(rows, stored_identifiers(spark, sf), known, merge, LOW, DAYS)


MATCH_SQL = {k: v for k, v in _cluster_sql(MERGE).items() if k in ("m", "pairs", "nearest")}


@query("e12_best_match_in_window", "SELECT item_id, match, round(score, 6) AS score FROM nearest", MATCH_SQL)
def best_match(spark, sf):
    rows = members(spark, sf)
    return S.best_earlier(rows, rows, DAYS * 86400, LOW).withColumn("score", F.round("score", 6))


@query("e13_story_clustering", "SELECT item_id, story_id, how, nearest, score FROM assigned", _cluster_sql(MERGE))
def clustering(spark, sf):
    return assigned(spark, sf).withColumn("score", F.round("score", 6))


PRIOR = "item_id % 4 = 0"


@query("e13_incremental_clustering", "SELECT item_id, story_id, how, nearest, score FROM assigned", _cluster_sql(MERGE, PRIOR))
def incremental(spark, sf):
    return assigned(spark, sf, MERGE, PRIOR).withColumn("score", F.round("score", 6))


@query("e14_story_roles", """
SELECT item_id, kind, item_id % 3 = 0 AS opens, CASE WHEN item_id % 3 = 0 THEN CASE kind WHEN 'paper' THEN 'paper' WHEN 'repo' THEN 'code' WHEN 'video' THEN 'video' WHEN 'discussion' THEN 'discussion' ELSE 'seed' END
 ELSE CASE kind WHEN 'paper' THEN 'paper' WHEN 'repo' THEN 'code' WHEN 'model' THEN 'code' WHEN 'video' THEN 'video' WHEN 'discussion' THEN 'discussion' ELSE 'coverage' END END AS role FROM items""")
def roles(spark, sf):
    opens = F.col("item_id") % 3 == 0
    return relation(spark, sf, "items").select("item_id", "kind", opens.alias("opens"), C.role(F.col("kind"), opens).alias("role"))


@query("e15_story_clock", """
SELECT s.story_id, max(CASE WHEN s.item_id = s.story_id THEN i.at END) AS first_seen, max(i.at) AS last_activity,
       max(CASE WHEN s.item_id = s.story_id OR i.kind IN ('paper', 'model', 'repo') THEN i.at END) AS materially_updated
FROM story_items s JOIN items i ON i.item_id = s.item_id GROUP BY s.story_id""")
def clock(spark, sf):
    return C.clocks(relation(spark, sf, "story_items"), relation(spark, sf, "items"))


@query("e16_ambiguous_band", "SELECT item_id, nearest, score FROM assigned WHERE how = 'ambiguous'", _cluster_sql(MERGE))
def ambiguous(spark, sf):
    rows = members(spark, sf)
    linked = C.parents(rows, stored_identifiers(spark, sf), MERGE, LOW, DAYS)
    return linked.where("how = 'ambiguous'").select("item_id", "nearest", F.round("score", 6).alias("score"))


STATS = """SELECT count(*) AS stories, CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi,
 max(n) AS largest, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS items_in_multi FROM (SELECT story_id, count(*) AS n FROM {} GROUP BY story_id) x"""


@query("e17_cluster_stats", STATS.format("story_items"))
def cluster_stats(spark, sf):
    return C.stats(relation(spark, sf, "story_items"))


@query("e18_recluster", STATS.format("assigned"), _cluster_sql(0.30))
def recluster(spark, sf):
    return C.stats(assigned(spark, sf, 0.30))


def _kept(spark, sf):
    return relation(spark, sf, "items").where("triage_state = 'kept'")


POSITIVE = {
    **IDENTIFIERS,
    "held": f"SELECT d.* FROM identifiers d JOIN items i ON i.item_id = d.item_id AND i.triage_state = 'kept' WHERE d.type IN {STRONG}",
    "positive": """SELECT x.item_id AS a, y.item_id AS b, x.type, x.value FROM held x JOIN held y ON y.type = x.type AND y.value = x.value AND x.item_id < y.item_id
      WHERE (x.type, x.value) IN (SELECT (type, value) FROM held GROUP BY type, value HAVING count(*) BETWEEN 2 AND 8)""",
    "paper_items": """SELECT arg_min(i.item_id, (i.at, i.item_id)) AS item_id, min(i.at) AS t FROM identifiers d JOIN items i ON i.item_id = d.item_id
      WHERE d.type = 'arxiv' AND i.triage_state = 'kept' AND i.kind = 'paper' GROUP BY d.value""",
    "hard": """SELECT least(a.item_id, b.item_id) AS a, greatest(a.item_id, b.item_id) AS b, list_dot_product(va.embedding::DOUBLE[], vb.embedding::DOUBLE[]) AS score FROM paper_items a JOIN paper_items b ON a.item_id < b.item_id AND abs(a.t - b.t) <= 604800
      JOIN vectors va ON va.item_id = a.item_id JOIN vectors vb ON vb.item_id = b.item_id""",
    "positive_scores": """SELECT p.*, list_dot_product(va.embedding::DOUBLE[], vb.embedding::DOUBLE[]) AS score FROM positive p JOIN vectors va ON va.item_id = p.a JOIN vectors vb ON vb.item_id = p.b""",
}


def _positive_scores(spark, sf, keys=None):
    pairs = K.positives(keys or stored_identifiers(spark, sf), _kept(spark, sf))
    return K.pair_scores(pairs, relation(spark, sf, "vectors"))


def _hard_items(spark, sf, keys=None):
    found = K.papers(keys or stored_identifiers(spark, sf), _kept(spark, sf))
    return found.join(relation(spark, sf, "vectors").select("item_id", "embedding"), "item_id")


def _hard_bins(spark, sf, keys=None):
    return K.close_pair_bins(_hard_items(spark, sf, keys))


@query("e19_positive_pairs", "SELECT a, b, type, value FROM positive", POSITIVE)
def positives(spark, sf):
    return K.positives(stored_identifiers(spark, sf), _kept(spark, sf))


@query("e20_hard_negatives", "SELECT CAST(floor(round(score * 10000, 6)) AS INTEGER) AS bin, count(*) AS pairs FROM hard GROUP BY 1", POSITIVE)
def hard_negatives(spark, sf):
    return _hard_bins(spark, sf)


@query("e20_hard_pairs", f"SELECT a, b, round(score, 6) AS score FROM hard WHERE score >= {LOW}", POSITIVE)
def hard_pairs(spark, sf):
    return K.close_pairs(_hard_items(spark, sf), LOW).withColumn("score", F.round("score", 6))


DRAWS = 4000
DRAWN = "CAST('0x' || substring(md5(CAST(k AS VARCHAR) || ':7:{0}'), 1, 8) AS BIGINT) % (SELECT count(*) FROM placed)"
RANDOM_SQL = {
    "placed": "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM items WHERE triage_state = 'kept'",
    "draws": f"SELECT {DRAWN.format(0)} AS x, {DRAWN.format(1)} AS y FROM range({DRAWS}) r(k)",
}


@query("e21_random_negatives", """SELECT DISTINCT least(p.item_id, q.item_id) AS a, greatest(p.item_id, q.item_id) AS b
FROM draws JOIN placed p ON p.place = x JOIN placed q ON q.place = y WHERE x <> y""", RANDOM_SQL)
def random_negatives(spark, sf):
    return K.random_pairs(_kept(spark, sf), DRAWS)


@query("e22_pair_scores", "SELECT a, b, type, value, round(score, 6) AS score FROM positive_scores", POSITIVE)
def pair_scores(spark, sf):
    return _positive_scores(spark, sf).withColumn("score", F.round("score", 6))


@query("e23_distribution_summary", """
SELECT count(*) AS n, round(min(score), 6) AS min, round(quantile_cont(score, 0.05), 6) AS p5, round(median(score), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(max(score), 6) AS max
FROM positive_scores""", POSITIVE)
def distribution(spark, sf):
    found = K.summary(_positive_scores(spark, sf))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("min", "p5", "median", "p95", "max")])


GRID = [-0.1, 0.0, 0.1, 0.2, 0.3]


@query("e24_threshold_trade_off", f"""
SELECT t AS threshold, (SELECT count(*) FROM positive_scores WHERE score >= t) AS caught, (SELECT count(*) FROM positive_scores) AS positives,
  (SELECT count(*) FROM hard WHERE score >= t) AS false_merges, (SELECT count(*) FROM hard) AS hard_pairs,
  round((SELECT count(*) FROM positive_scores WHERE score >= t) / (SELECT count(*) FROM positive_scores), 6) AS recall
FROM (SELECT unnest({GRID}::DOUBLE[]) AS t) g""", POSITIVE)
def trade_off(spark, sf):
    keys = stored_identifiers(spark, sf)
    return K.trade_off(_positive_scores(spark, sf, keys), _hard_bins(spark, sf, keys), GRID).withColumn("recall", F.round("recall", 6))
