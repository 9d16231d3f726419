"""Reader views and the topic graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import embed as M
from storyloom.functions import text as X
from storyloom.functions import vectors as V
from storyloom.model import NOW, relation, table
from storyloom.operators import feed as G
from storyloom.operators import graph as N
from storyloom.operators import readers as H
from storyloom.operators import tree as R
from storyloom.plans.feed import CARDS, rel
from storyloom.plans.labels import CENTROIDS, TREE, story_centroids, tree
from storyloom.plans.registry import query
from storyloom.plans.similarity import means_sql, reference_vectors
from storyloom.session import cut_lineage

FIT, EVENT = 0.30, 0.45
WORDS = f"list_distinct(list_filter(string_split_regex(lower(name), '[^\\pL\\pN]+'), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(repr(w) for w in X.SMALL_WORDS)})))"
NAMED = {
    **CARDS,
    "asked_texts": "SELECT story_id, title || ' ' || coalesce(summary, '') AS text FROM card UNION ALL SELECT s.story_id, i.title FROM story_items s JOIN items i ON i.item_id = s.item_id",
    "name_words": f"SELECT name, len({WORDS}) AS needed, unnest({WORDS}) AS word FROM (SELECT DISTINCT name FROM reader_topics WHERE spine IS NULL AND example IS NULL) n",
    "word_hits": r"SELECT DISTINCT w.name, w.needed, w.word, t.story_id FROM name_words w JOIN asked_texts t ON regexp_matches(lower(t.text), '(^|[^\pL\pN])' || w.word || '(s|es)?($|[^\pL\pN])')",
    "named": "SELECT name, story_id FROM word_hits GROUP BY name, story_id, needed HAVING count(*) = needed",
}
PLACES = {**TREE, "places": "SELECT DISTINCT t.story_id, c.ancestor AS place FROM story_topics t JOIN tree c ON c.slug = t.slug"}
FITTING = {
    **NAMED, **PLACES, **CENTROIDS,
    "taught": "SELECT e.topic_key, e.example FROM topic_examples e JOIN stories s ON s.story_id = e.example",
    "event_vec": means_sql("topic_key", source="(SELECT e.topic_key, c.vec AS embedding FROM taught e JOIN centroids c ON c.key = e.example)"),
    "near": f"SELECT v.key AS topic_key, c.key AS story_id FROM event_vec v JOIN centroids c ON list_dot_product(v.vec, c.vec) >= {EVENT} UNION SELECT topic_key, example FROM taught",
    "fitting": """SELECT DISTINCT topic_key, story_id FROM (
        SELECT topic_key, story_id FROM near
        UNION ALL SELECT t.topic_key, p.story_id FROM reader_topics t JOIN places p ON p.place = t.spine WHERE t.topic_key NOT IN (SELECT topic_key FROM taught)
        UNION ALL SELECT t.topic_key, n.story_id FROM reader_topics t JOIN named n ON n.name = t.name WHERE t.spine IS NULL AND t.topic_key NOT IN (SELECT topic_key FROM taught)) x""",
    "story_sources": "SELECT DISTINCT s.story_id, i.source FROM story_items s JOIN items i ON i.item_id = s.item_id",
    **CARDS,
    "in_topic": """SELECT t.reader, t.topic_key, f.story_id FROM fitting f JOIN reader_topics t ON t.topic_key = f.topic_key JOIN card c ON c.story_id = f.story_id
       WHERE EXISTS (SELECT 1 FROM reader_topic_sources r JOIN story_sources s ON s.source = r.source WHERE r.topic_key = f.topic_key AND s.story_id = f.story_id)
         AND NOT EXISTS (SELECT 1 FROM topic_muted m WHERE m.topic_key = f.topic_key AND contains(lower(concat_ws(' ', c.title, coalesce(c.summary, ''))), lower(m.word)))""",
}
READ_SQL = "EXISTS (SELECT 1 FROM interactions x WHERE x.reader = t.reader AND x.story_id = t.story_id AND x.action = 'seen')"


def story_sources(spark, sf):
    members, items = rel(spark, sf, "story_items", "items")
    return members.join(items.select("item_id", "source"), "item_id").select("story_id", "source").distinct()


def story_places(spark, sf, closure=None):
    return H.places(relation(spark, sf, "story_topics"), tree(spark, sf) if closure is None else closure)


def examples(spark, sf):
    """The examples that are stories."""
    stories = relation(spark, sf, "stories").select(F.col("story_id").alias("example"))
    return relation(spark, sf, "topic_examples").join(stories, "example", "left_semi")


def asked_texts(spark, sf, cards=None):
    return H.story_texts(all_cards(spark, sf) if cards is None else cards, *rel(spark, sf, "story_items", "items"))


def all_cards(spark, sf):
    stories, members, items, seen = rel(spark, sf, "stories", "story_items", "items", "interactions")
    return G.cards(stories, stories, members, items, seen)


def offers(spark, sf, *about):
    """The offers readers' topics take, each story with columns of its card (``about``)."""
    topics, sources, muted = rel(spark, sf, "reader_topics", "reader_topic_sources", "topic_muted")
    # Both are read several times, and the plans that make them are long.
    cards, centroids = cut_lineage(all_cards(spark, sf).select("story_id", "title", "summary", *about)), cut_lineage(story_centroids(spark, sf))
    return H.topic_offers(topics, examples(spark, sf), story_places(spark, sf), asked_texts(spark, sf, cards), centroids, sources,
                          story_sources(spark, sf), cards, muted, EVENT)


def fresh():
    return H.fresh(F.col("published_s"), NOW).alias("fresh")


def seen_by(spark, sf):
    return relation(spark, sf, "interactions").where("action = 'seen'")


@query("h01_topic_membership", "SELECT reader, topic_key, story_id FROM in_topic", FITTING)
def topic_membership(spark, sf):
    return H.taken(*offers(spark, sf)).select("reader", "topic_key", "story_id")


VECTOR_TOPICS = {**FITTING, "leaf_vec": means_sql("label"),
                 "pointed": f"""SELECT t.topic_key, c.key AS story_id FROM reader_topics t JOIN leaf_vec l ON l.key = t.reader % 10 JOIN centroids c ON list_dot_product(c.vec, l.vec) >= {FIT}
                    WHERE t.reader % 3 = 2 AND t.spine IS NULL AND t.topic_key NOT IN (SELECT topic_key FROM taught)"""}


@query("h02_fits", "SELECT topic_key, story_id FROM fitting UNION SELECT topic_key, story_id FROM pointed", VECTOR_TOPICS)
def fits(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("slot", F.col("label"))
    pointers = V.mean_direction(rows, ["slot"]).select("slot", F.col("centroid").alias("vector"))
    topics = relation(spark, sf, "reader_topics")
    slot = F.when(F.col("reader") % 3 == 2, (F.col("reader") % 10).cast("int"))
    topics = topics.withColumn("slot", slot).join(pointers, "slot", "left")
    return H.fits(topics, examples(spark, sf), story_places(spark, sf), asked_texts(spark, sf), story_centroids(spark, sf), EVENT, FIT)


@query("h03_name_match", "SELECT name, story_id FROM named", NAMED)
def name_match(spark, sf):
    names = relation(spark, sf, "reader_topics").where("spine IS NULL AND example IS NULL")
    return H.named_in(names, asked_texts(spark, sf))


@query("h04_event_topics", "SELECT topic_key, story_id FROM near", FITTING)
def event_topics(spark, sf):
    rows = H.defined(relation(spark, sf, "reader_topics"), examples(spark, sf)).where("taught IS NOT NULL")
    found = H.like_examples(rows.select("definition", F.explode("taught").alias("example")).distinct(), story_centroids(spark, sf), EVENT)
    return rows.select("topic_key", "definition").join(found, "definition").select("topic_key", "story_id")


@query("h05_nearby_stories", f"""
SELECT a.key AS story_id, b.key AS near FROM centroids a JOIN centroids b ON list_dot_product(a.vec, b.vec) >= {FIT} OR a.key = b.key
WHERE a.key IN (SELECT story_id FROM stories WHERE title IS NOT NULL)
UNION SELECT story_id, story_id FROM stories WHERE title IS NOT NULL""", CENTROIDS)
def nearby(spark, sf):
    return H.nearby(relation(spark, sf, "stories").where("title IS NOT NULL").select("story_id"), story_centroids(spark, sf), FIT)


@query("h06_example_vectors", "SELECT key AS bucket, array_to_string(list_transform(vec, lambda x: CAST(greatest(-127, least(127, round_even(x * 127, 0))) AS INTEGER)), ',') AS packed FROM example_means", {
    **CENTROIDS, "examples": "SELECT DISTINCT reader_rank % 50 AS bucket, example FROM reader_topics WHERE example IS NOT NULL",
    "example_rows": "SELECT e.bucket, c.vec AS embedding FROM examples e JOIN centroids c ON c.key = e.example",
    "example_means": means_sql("bucket", source="example_rows")})
def example_vectors(spark, sf):
    examples = relation(spark, sf, "reader_topics").where("example IS NOT NULL").select((F.col("reader_rank") % 50).alias("bucket"), "example").distinct()
    rows = H.example_vectors(examples, story_centroids(spark, sf), "bucket")
    return rows.select("bucket", F.array_join(V.packed("vector"), ",").alias("packed"))


NEW = f"coalesce({NOW} - c.published_s < 172800, false) AND NOT {READ_SQL}"


@query("h07_new_stories", f"SELECT t.reader, t.topic_key, t.story_id, {NEW} AS is_new FROM in_topic t JOIN card c ON c.story_id = t.story_id", FITTING)
def new_stories(spark, sf):
    return H.new_rows(*offers(spark, sf, fresh()), seen_by(spark, sf)).select("reader", "topic_key", "story_id", "is_new")


@query("h08_reader_feed", "SELECT DISTINCT t.reader, t.story_id, c.published_s FROM in_topic t JOIN card c ON c.story_id = t.story_id", FITTING)
def reader_feed(spark, sf):
    return H.read_order(*offers(spark, sf, "published_s"))


@query("h08_new_per_topic", f"SELECT t.topic_key, count(*) FILTER ({NEW}) AS new, count(*) AS stories FROM in_topic t JOIN card c ON c.story_id = t.story_id GROUP BY t.topic_key", FITTING)
def new_per_topic(spark, sf):
    return H.new_counts(*offers(spark, sf, fresh()), seen_by(spark, sf))


@query("h09_follow_state", "SELECT t.reader, c.slug AS place, CASE WHEN min(c.distance) = 0 THEN 'own' ELSE 'via' END AS state FROM reader_topics t JOIN tree c ON c.ancestor = t.spine GROUP BY t.reader, c.slug", TREE)
def follow_state(spark, sf):
    return H.following(relation(spark, sf, "reader_topics"), tree(spark, sf))


@query("h10_story_places", "SELECT story_id, place FROM places", PLACES)
def places(spark, sf):
    return story_places(spark, sf)


CATALOG = {"weeks": f"SELECT i.source, count(*) FILTER (i.at > {NOW} - 7 * 86400) AS week FROM items i JOIN story_items s ON s.item_id = i.item_id GROUP BY i.source",
           "tops": """SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY newest DESC, title) AS place FROM (SELECT i.source, i.title, max(i.at) AS newest FROM items i GROUP BY i.source, i.title) x QUALIFY place <= 3""",
           "catalog": "SELECT w.source, w.week, (SELECT string_agg(title, ' | ' ORDER BY place) FROM tops t WHERE t.source = w.source) AS latest FROM weeks w"}


def catalogue_rows(spark, sf):
    return H.catalogue(*rel(spark, sf, "items", "story_items"), NOW)


@query("h11_source_catalogue", "SELECT source, week, latest FROM catalog", CATALOG)
def catalogue(spark, sf):
    return catalogue_rows(spark, sf).withColumn("latest", F.array_join("latest", " | "))


SOURCE_PLACES = {**PLACES, "story_sources": FITTING["story_sources"], "source_places": "SELECT s.source, p.place, count(*) AS stories FROM story_sources s JOIN places p ON p.story_id = s.story_id GROUP BY s.source, p.place"}


@query("h11_source_places", "SELECT source, place, stories FROM source_places", SOURCE_PLACES)
def source_places(spark, sf):
    return H.source_places(story_sources(spark, sf), story_places(spark, sf))


@query("h12_sources_for_place", "SELECT source, place, stories, CAST(row_number() OVER (PARTITION BY place ORDER BY stories DESC, source) AS INTEGER) AS position FROM source_places", SOURCE_PLACES)
def sources_for_place(spark, sf):
    return H.sources_for(H.source_places(story_sources(spark, sf), story_places(spark, sf)))


# A source of the small tables brings five or six items a week, so here six are many.
@query("h13_busy_sources", "SELECT source, week FROM weeks WHERE week >= 6", CATALOG)
def busy_sources(spark, sf):
    return H.busy(catalogue_rows(spark, sf), 6).select("source", "week")


@query("h14_rank_sources", """
SELECT slug AS "set", source, stories, CAST(row_number() OVER (PARTITION BY slug ORDER BY stories DESC, week DESC, source) AS INTEGER) AS position FROM (
  SELECT t.slug, s.source, count(*) AS stories, w.week FROM story_topics t JOIN story_sources s ON s.story_id = t.story_id JOIN weeks w ON w.source = s.source GROUP BY t.slug, s.source, w.week) x QUALIFY position <= 8""", {**CATALOG, "story_sources": FITTING["story_sources"]})
def rank_sources(spark, sf):
    sets = relation(spark, sf, "story_topics").select(F.col("slug").alias("set"), "story_id")
    return H.rank_sources(sets, story_sources(spark, sf), catalogue_rows(spark, sf)).select("set", "source", "stories", "position")


@query("h15_related_places", """
SELECT source AS "set", slug, stories, CAST(row_number() OVER (PARTITION BY source ORDER BY stories DESC, slug) AS INTEGER) AS position FROM (
  SELECT s.source, t.slug, count(*) AS stories FROM story_sources s JOIN story_topics t ON t.story_id = s.story_id GROUP BY s.source, t.slug) x QUALIFY position <= 4""", {"story_sources": FITTING["story_sources"]})
def related_places(spark, sf):
    return H.related_places(story_sources(spark, sf).withColumnRenamed("source", "set"), relation(spark, sf, "story_topics"))


@query("h16_subject_sources", f"""
SELECT "set", source, stories, week, latest, CAST(row_number() OVER (PARTITION BY "set" ORDER BY stories DESC, source) AS INTEGER) AS position FROM (
  SELECT l.key AS "set", s.source, count(*) AS stories, c.week, c.latest FROM leaf_vec l JOIN centroids v ON list_dot_product(v.vec, l.vec) >= 0.2
    JOIN stories x ON x.story_id = v.key AND x.last_activity >= {NOW} - 30 * 86400 JOIN story_sources s ON s.story_id = v.key JOIN catalog c ON c.source = s.source
  GROUP BY l.key, s.source, c.week, c.latest) y QUALIFY position <= 8""", {**CENTROIDS, **CATALOG, "leaf_vec": means_sql("label"), "story_sources": FITTING["story_sources"]})
def subject_sources(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("key", F.col("label"))
    subjects = V.mean_direction(rows, ["key"]).select("key", F.col("centroid").alias("vector"))
    recent = relation(spark, sf, "stories").where(F.col("last_activity") >= NOW - 30 * 86400).select("story_id")
    sets = H.for_subjects(subjects, story_centroids(spark, sf).join(recent, "story_id", "left_semi"), 0.2)
    # Here ties go by name, not by the week's count.
    ranked = H.rank_sources(sets, story_sources(spark, sf), catalogue_rows(spark, sf).withColumn("busy", F.col("week")).withColumn("week", F.lit(0)))
    return ranked.select("set", "source", "stories", F.col("busy").alias("week"), F.array_join("latest", " | ").alias("latest"), "position")


@query("h17_profile_view", """
SELECT t.reader, t.topic_key, t.name, t.spine, t.example, t.muted, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM reader_topic_sources r WHERE r.topic_key = t.topic_key) AS sources,
  (SELECT count(DISTINCT story_id) FROM interactions x WHERE x.reader = t.reader AND x.action = 'seen') AS stories_seen FROM reader_topics t""")
def profile_view(spark, sf):
    topics, sources = rel(spark, sf, "reader_topics", "reader_topic_sources")
    rows = H.profile_rows(topics, sources, seen_by(spark, sf))
    return rows.select("reader", "topic_key", "name", "spine", "example", "muted", F.array_join("sources", ",").alias("sources"), "stories_seen")


IMPRESSIONS = {"impressions": "SELECT user_id AS reader, CAST(substring(props, 7, length(props) - 7) AS BIGINT) % 25 AS story_id, CASE event_type WHEN 'view' THEN 'shown' WHEN 'click' THEN 'passed' WHEN 'purchase' THEN 'end' END AS action, event_id AS seq FROM @events WHERE event_type IN ('view', 'click', 'purchase')"}


def impressions(events):
    action = F.when(F.col("event_type") == "view", "shown").when(F.col("event_type") == "click", "passed").when(F.col("event_type") == "purchase", "end")
    return events.select(F.col("user_id").alias("reader"), (F.get_json_object("props", "$.k").cast("long") % 25).alias("story_id"),
                         action.alias("action"), F.col("event_id").alias("seq")).where("action IS NOT NULL")


@query("h18_read_marks", """
SELECT DISTINCT s.reader, s.story_id FROM impressions s WHERE s.action = 'shown' AND EXISTS (SELECT 1 FROM impressions p WHERE p.reader = s.reader AND p.seq > s.seq
  AND (p.action = 'end' OR (p.action = 'passed' AND p.story_id = s.story_id)))""", IMPRESSIONS)
def read_marks(spark, sf):
    return H.read_marks(impressions(table(spark, sf, "events")))


PACKED = "list_transform({0}, lambda x: greatest(-127, least(127, round_even(x * 127, 0))))"
TREE_NODES = {
    **PLACES, **CENTROIDS,
    "packed_rows": f"SELECT p.place, {PACKED.format('c.vec')} AS embedding FROM places p JOIN centroids c ON c.key = p.story_id",
    "node_vec": means_sql("place", source="packed_rows"),
    "nodes": """SELECT s.slug AS key, (SELECT max(distance) + 1 FROM tree t WHERE t.slug = s.slug) AS depth, s.parent, v.vec,
       EXISTS (SELECT 1 FROM spine k WHERE k.parent = s.slug) AS branch FROM spine s JOIN node_vec v ON v.key = s.slug""",
}
TREE_PAIRS = "SELECT a.key, b.key AS other, list_dot_product(a.vec, b.vec) AS s, a.depth = 1 AND a.branch AND b.branch AS tops FROM nodes a JOIN nodes b ON a.key <> b.key AND a.depth = b.depth AND (a.depth = 1 OR a.parent <> b.parent)"
LEAF_VECTORS = {"leaf_vec": means_sql("label")}
# Own topics lie where the stories that fit them lie, else at their own vector.
NODE_SQL = {
    **TREE_NODES, **FITTING, **LEAF_VECTORS,
    "told": "SELECT t.topic_key, coalesce('e' || (SELECT list_sort(list(e.example))::VARCHAR FROM taught e WHERE e.topic_key = t.topic_key), 'n' || t.name) AS said FROM reader_topics t WHERE t.spine IS NULL",
    "speaker": "SELECT said, min(topic_key) AS topic_key FROM told GROUP BY said",
    "own_rows": f"SELECT s.said, {PACKED.format('c.vec')} AS embedding FROM speaker s JOIN fitting f ON f.topic_key = s.topic_key JOIN centroids c ON c.key = f.story_id",
    "own_mean": means_sql("said", source="own_rows"),
    "leaf_rows": f"SELECT key AS leaf, {PACKED.format('vec')} AS embedding FROM leaf_vec",
    "leaf_mean": means_sql("leaf", source="leaf_rows"),
    "own": """SELECT g.reader, 'own:' || g.topic_key AS key, coalesce(m.vec, l.vec) AS vec FROM graph_topics g JOIN told t ON t.topic_key = g.topic_key
       LEFT JOIN own_mean m ON m.key = t.said LEFT JOIN leaf_mean l ON g.taken_from % 3 = 2 AND l.key = g.taken_from % 10 WHERE coalesce(m.vec, l.vec) IS NOT NULL""",
    "tree_pairs": TREE_PAIRS,
    "met": "SELECT o.reader, o.key, n.key AS other, list_dot_product(o.vec, n.vec) AS s, n.depth = 1 AND n.branch AS tops FROM own o CROSS JOIN nodes n",
    "compared": """SELECT CAST(NULL AS BIGINT) AS reader, * FROM tree_pairs
       UNION ALL SELECT r.reader, p.* FROM (SELECT DISTINCT reader FROM own) r CROSS JOIN tree_pairs p
       UNION ALL SELECT reader, key, other, s, tops FROM met UNION ALL SELECT reader, other, key, s, tops FROM met
       UNION ALL SELECT a.reader, a.key, b.key, list_dot_product(a.vec, b.vec), true FROM own a JOIN own b ON a.reader = b.reader AND a.key <> b.key""",
}


def lifted_sql(source: str, n: int) -> str:
    """(reader, key, other, score, lift): the ``n`` closest of ``source`` that stand out."""
    return f"""SELECT reader, key, other, score, lift FROM (SELECT *, row_number() OVER (PARTITION BY reader, key ORDER BY score DESC, other) AS rn FROM (
        SELECT reader, key, other, s AS score, (s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0) AS lift, count(*) OVER w AS n, stddev_pop(s) OVER w AS sd
        FROM {source} WINDOW w AS (PARTITION BY reader, key)) x WHERE n >= 2 AND sd >= 1e-6 AND lift >= 1 - 1e-9) y WHERE rn <= {n}"""


def links_sql(source: str) -> str:
    return f"SELECT reader, least(key, other) AS a, greatest(key, other) AS b, arg_min(lift, key) AS strength FROM ({lifted_sql(source, 1)}) z GROUP BY 1, 2, 3"


def node_rows(spark, sf, closure=None, centroids=None):
    closure = tree(spark, sf) if closure is None else closure
    vectors = N.topic_vectors(story_places(spark, sf, closure), story_centroids(spark, sf) if centroids is None else centroids)
    return N.nodes(relation(spark, sf, "spine"), closure, vectors)


def own_nodes(spark, sf, closure, centroids):
    topics = relation(spark, sf, "graph_topics").where("spine IS NULL")
    rows = cut_lineage(H.defined(topics, examples(spark, sf)))
    fitting = H.fits_definitions(rows, story_places(spark, sf, closure), asked_texts(spark, sf), centroids, EVENT)
    leaves = reference_vectors(spark, sf, "label").withColumnRenamed("key", "slot")
    slot = F.when(F.col("taken_from") % 3 == 2, (F.col("taken_from") % 10).cast("int"))
    return N.own_nodes(rows.withColumn("slot", slot).join(leaves, "slot", "left"), fitting, centroids)


def pictured(spark, sf):
    """The closure of the tree, its nodes and the nodes of own topics; what both kinds of nodes need is made once."""
    closure, centroids = tree(spark, sf), cut_lineage(story_centroids(spark, sf))
    return closure, node_rows(spark, sf, closure, centroids), own_nodes(spark, sf, closure, centroids)


@query("h19_topic_vectors", "SELECT key AS place, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, round(unnest(vec), 6) AS value FROM node_vec", TREE_NODES)
def topic_vectors(spark, sf):
    vectors = N.topic_vectors(story_places(spark, sf), story_centroids(spark, sf))
    return vectors.select("place", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("h20_own_nodes", "SELECT reader, key, array_to_string(list_transform(vec, lambda x: CAST(greatest(-127, least(127, round_even(x * 127, 0))) AS INTEGER)), ',') AS packed FROM own", NODE_SQL)
def graph_own_nodes(spark, sf):
    return pictured(spark, sf)[2].select("reader", "key", F.array_join(V.packed("vector"), ",").alias("packed"))


def rounded(found):
    return found.withColumn("score", F.round("score", 6)).withColumn("lift", F.round("lift", 5))


@query("h20_related_topics", f"SELECT key, other, round(score, 6) AS score, round(lift, 5) AS lift FROM ({lifted_sql('tree_alone', 3)}) c", {
    **TREE_NODES, "tree_alone": f"SELECT NULL AS reader, * FROM ({TREE_PAIRS}) t"})
def related_topics(spark, sf):
    return rounded(N.closest(node_rows(spark, sf), 3)).drop("reader")


@query("h20_related_with_own", f"SELECT reader, key, other, round(score, 6) AS score, round(lift, 5) AS lift FROM ({lifted_sql('compared', 3)}) c", NODE_SQL)
def related_with_own(spark, sf):
    _, nodes, own = pictured(spark, sf)
    return rounded(N.closest_with_own(nodes, own, 3))


OVERVIEW_SQL = {**NODE_SQL, "top_pairs": "SELECT * FROM compared WHERE tops", "overview": links_sql("top_pairs")}


@query("h21_overview_edges", "SELECT a, b, round(strength, 5) AS strength FROM tree_links", {
    **TREE_NODES, "tree_tops": f"SELECT NULL AS reader, * FROM ({TREE_PAIRS}) t WHERE tops", "tree_links": links_sql("tree_tops")})
def overview_edges(spark, sf):
    return N.overview_edges(node_rows(spark, sf)).withColumn("strength", F.round("strength", 5)).drop("reader")


@query("h21_overview_with_own", "SELECT reader, a, b, round(strength, 5) AS strength FROM overview", OVERVIEW_SQL)
def overview_with_own(spark, sf):
    _, nodes, own = pictured(spark, sf)
    return N.overview_edges(nodes, own).withColumn("strength", F.round("strength", 5))


GRAPH_SQL = {**OVERVIEW_SQL, "visible": """SELECT DISTINCT t.reader, c.ancestor AS slug FROM graph_topics t JOIN tree c ON c.slug = t.spine
    UNION SELECT DISTINCT t.reader, c.slug FROM graph_topics t JOIN tree c ON c.ancestor = t.spine""",
    "in_picture": "SELECT reader, slug AS key FROM visible UNION ALL SELECT reader, key FROM own",
    # The overview of a picture compares only what the picture shows.
    "shown_pairs": """SELECT p.reader, c.key, c.other, c.s FROM (SELECT key, other, s FROM tree_pairs WHERE tops) c JOIN in_picture p ON p.key = c.key JOIN in_picture q ON q.key = c.other AND q.reader = p.reader
       UNION ALL SELECT c.reader, c.key, c.other, c.s FROM compared c JOIN in_picture p ON p.reader = c.reader AND p.key = c.key JOIN in_picture q ON q.reader = c.reader AND q.key = c.other
       WHERE c.tops AND (c.key LIKE 'own:%' OR c.other LIKE 'own:%')""",
    "picture_links": links_sql("shown_pairs"),
    "src": "SELECT t.reader, coalesce(t.spine, 'own:' || t.topic_key) AS a, 'src:' || r.source AS b FROM (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY source) AS n FROM reader_topic_sources) r JOIN graph_topics t ON t.topic_key = r.topic_key WHERE r.n <= 4"}


@query("h22_topic_graph", """
SELECT v.reader, coalesce(s.parent, 'area') AS a, v.slug AS b, 'tree' AS kind FROM visible v JOIN spine s ON s.slug = v.slug
UNION ALL SELECT reader, a, b, 'src' FROM src
UNION ALL SELECT reader, a, b, 'rel' FROM picture_links""", GRAPH_SQL)
def topic_graph(spark, sf):
    topics, sources, spine = rel(spark, sf, "graph_topics", "reader_topic_sources", "spine")
    closure, nodes, own = pictured(spark, sf)
    related = N.overview_edges(cut_lineage(N.pictures(topics, closure, nodes, own)))
    return N.edges(topics, sources, spine, closure, related)


@query("h22_whole_graph", """
SELECT CAST(NULL AS BIGINT) AS reader, coalesce(parent, 'area') AS a, slug AS b, 'tree' AS kind FROM spine
UNION ALL SELECT reader, a, b, 'src' FROM src UNION ALL SELECT reader, a, b, 'rel' FROM overview""", GRAPH_SQL)
def whole_graph(spark, sf):
    topics, sources, spine = rel(spark, sf, "graph_topics", "reader_topic_sources", "spine")
    closure, nodes, own = pictured(spark, sf)
    return N.edges(topics, sources, spine, closure, N.overview_edges(nodes, own), "all")


@query("h23_categories", "SELECT s.slug, s.name, (SELECT string_agg(c.slug, ',' ORDER BY c.ord) FROM spine c WHERE c.parent = s.slug) AS children FROM spine s WHERE s.parent IS NULL")
def categories(spark, sf):
    return R.children(relation(spark, sf, "spine")).withColumn("children", F.array_join("children", ","))


PACK = "array_to_string(list_transform({0}, lambda x: CAST(greatest(-127, least(127, round_even(x * 127, 0))) AS INTEGER)), ',')"
SAVED = {
    **CENTROIDS,
    "doc_vec": """SELECT name AS key, list(CAST(coalesce(n, 0) / len AS FLOAT)::DOUBLE ORDER BY pos) AS vec FROM (
        SELECT d.name, d.len, r.pos, t.n FROM (SELECT name, sqrt(sum(n * n)) AS len FROM terms GROUP BY name) d CROSS JOIN (SELECT unnest(range(64)) AS pos) r LEFT JOIN terms t ON t.name = d.name AND t.dim = r.pos) x GROUP BY name""",
}
SAVED = {**CENTROIDS,
         "terms": "SELECT name, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n FROM (SELECT name, unnest(regexp_extract_all(lower(name), '[\\pL\\pN]+')) AS w FROM (SELECT DISTINCT name FROM reader_topics) d) e GROUP BY name, dim",
         "doc_vec": SAVED["doc_vec"]}


@query("h24_save_topics", f"""
SELECT t.reader, lower(trim(regexp_replace(lower(t.name), '[^a-z0-9]+', '-', 'g'), '-')) AS key, t.name, t.spine, t.example, coalesce(t.muted, '') AS muted,
  coalesce({PACK.format('c.vec')}, CASE WHEN t.reader % 5 = 0 THEN '1,2' END, CASE WHEN t.spine IS NULL THEN {PACK.format('d.vec')} END) AS vector
FROM reader_topics t LEFT JOIN centroids c ON c.key = t.example LEFT JOIN doc_vec d ON d.key = t.name""", SAVED)
def save_topics(spark, sf):
    topics = relation(spark, sf, "reader_topics")
    sent = topics.select(
        "reader", F.lit(None).cast("string").alias("key"), F.concat(F.lit("  "), "name", F.lit(" ")).alias("name"), F.lit(None).cast("string").alias("description"),
        "spine", "example", F.array(F.coalesce(F.concat(F.col("muted"), F.lit(" ")), F.lit(" "))).alias("muted"),
    )
    stored = topics.where("reader % 5 <= 1").select(
        "reader", X.slug(F.col("name")).alias("key"), F.when(F.col("reader") % 5 == 0, F.col("name")).otherwise("older words").alias("description"),
        F.array(F.lit(1), F.lit(2)).alias("vector"),
    )
    embed = lambda text: F.transform(M.embedded(text, M.hashed_terms()), lambda x: x.cast("double"))
    rows = H.save_topics(stored, sent, story_centroids(spark, sf), embed)
    return rows.select("reader", "key", "name", "spine", "example", F.array_join("muted", ",").alias("muted"), F.array_join("vector", ",").alias("vector"))
