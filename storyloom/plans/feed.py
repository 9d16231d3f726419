"""Ranked, chronological and diversified feeds, cards, retention and the bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.model import NOW, RELATIONS, relation
from storyloom.operators import bundle as B
from storyloom.operators import feed as G
from storyloom.operators import tree as R
from storyloom.operators import topics as P
from storyloom.plans.labels import CENTROIDS, DEFAULTS, ENTITIES, ENTITY_SQL, FACETS, INHERITED, KIND_OF, TREE, entity_matches, story_centroids, tree
from storyloom.plans.registry import query
from storyloom.plans.scalars import COMMENTS_SQL, POINTS_SQL
from storyloom.session import scratch
from storyloom.sources import bundles

DAYS, LIMIT = 30, 20
DIMENSION = 64

AGG = {"agg": """SELECT s.story_id, max(i.triage_score) AS relevance, count(DISTINCT i.item_id) AS item_count, count(DISTINCT i.source) AS source_count,
   count(DISTINCT s.role) AS role_count, max(i.at) AS newest, min(i.at) AS origin FROM story_items s JOIN items i ON i.item_id = s.item_id GROUP BY s.story_id"""}


def score_sql(age: str = "newest") -> str:
    return (f"coalesce(relevance, 0) * pow(2, -(greatest({NOW} - {age}, 0) / 3600.0) / 48) "
            "* least(1 + 0.12 * (source_count - 1) + 0.08 * (role_count - 1), 1.25)")


WINDOWED = {**AGG, "shown": f"SELECT a.*, {score_sql()} AS score, {score_sql('origin')} AS origin_score FROM agg a WHERE floor(newest / 86400) >= {(NOW - DAYS * 86400) // 86400}"}
RANK = ("list_position(['paper','model','repo','video','article','post','discussion'], i.kind), "
        "list_position(['seed','paper','code','video','coverage','discussion'], s.role), -coalesce(i.triage_score, 0), i.item_id")
CARDS = {"card": f"""SELECT s.story_id, coalesce(x.title, arg_min(i.title, ({RANK}))) AS title, arg_min(i.summary, ({RANK})) FILTER (coalesce(i.summary, '') <> '') AS summary,
   arg_min(i.url, ({RANK})) AS url, arg_min(i.kind, ({RANK})) AS kind, arg_min(i.source, ({RANK})) AS source, arg_min(struct_pack(p := i.published_s), ({RANK})).p AS published_s,
   arg_min(i.media_url, i.item_id) FILTER (i.media_url IS NOT NULL) AS media_url, string_agg(DISTINCT i.source, ',' ORDER BY i.source) AS sources, count(*) AS item_count,
   {', '.join(f"count(*) FILTER (s.role = '{r}') AS n_{r}" for r in G.ROLE_ORDER)},
   s.story_id IN (SELECT story_id FROM interactions WHERE action = 'seen') AS seen
   FROM story_items s JOIN items i ON i.item_id = s.item_id JOIN stories x ON x.story_id = s.story_id GROUP BY s.story_id, x.title"""}


def rel(spark, sf, *names):
    return [relation(spark, sf, n) for n in names]


def story_rows(spark, sf, days=DAYS, unseen=False):
    stories, members, items, seen = rel(spark, sf, "stories", "story_items", "items", "interactions")
    return G.aggregates(G.window(stories, NOW, days, seen if unseen else None), members, items)


@query("g01_story_aggregates", f"""
SELECT story_id, relevance, item_count, source_count, role_count, newest, origin FROM agg
WHERE floor(newest / 86400) >= {(NOW - DAYS * 86400) // 86400} AND story_id NOT IN (SELECT story_id FROM interactions WHERE action = 'seen')""", AGG)
def aggregates(spark, sf):
    return story_rows(spark, sf, DAYS, True)


@query("g02_story_scores", f"SELECT story_id, round({score_sql()}, 6) AS score FROM agg", AGG)
def scores(spark, sf):
    return G.scored(story_rows(spark, sf, None), NOW).select("story_id", F.round("score", 6).alias("score"))


@query("g03_ranked_feed", f"SELECT story_id, round(score, 6) AS score, newest FROM shown ORDER BY score DESC, story_id LIMIT {LIMIT}", WINDOWED)
def ranked_feed(spark, sf):
    return G.ranked(story_rows(spark, sf), NOW, LIMIT).select("story_id", F.round("score", 6).alias("score"), "newest")


@query("g04_chronological_feed", "SELECT story_id, newest, round(score, 6) AS score FROM shown", WINDOWED)
def chronological(spark, sf):
    return G.recent(story_rows(spark, sf), NOW).select("story_id", "newest", F.round("score", 6).alias("score"))


# One pick after the other: what is left, each worth less for every pick of its source and of its kind.
DIVERSE = {
    **WINDOWED, **CARDS,
    "pool": f"SELECT s.story_id, s.score, c.source, c.kind FROM (SELECT story_id, score FROM shown ORDER BY score DESC, story_id LIMIT {G.pool_size(LIMIT)}) s JOIN card c ON c.story_id = s.story_id",
    "picked": f"""SELECT 0 AS place, []::BIGINT[] AS taken, []::VARCHAR[] AS sources, []::VARCHAR[] AS kinds,
         NULL::STRUCT(story_id BIGINT, source VARCHAR, kind VARCHAR, score DOUBLE, damped DOUBLE) AS best
       UNION ALL SELECT place + 1, list_append(taken, best.story_id), list_append(sources, best.source), list_append(kinds, best.kind), best FROM (
         SELECT place, taken, sources, kinds, arg_max(struct_pack(story_id := CAST(story_id AS BIGINT), source := source, kind := kind, score := score, damped := v), (v, score, -story_id)) AS best FROM (
           SELECT p.place, p.taken, p.sources, p.kinds, c.story_id, c.source, c.kind, c.score,
             c.score * (pow({G.SOURCE_DECAY}, len(list_filter(p.sources, lambda x: x = c.source))) * pow({G.KIND_DECAY}, len(list_filter(p.kinds, lambda x: x = c.kind)))) AS v
           FROM picked p JOIN pool c ON p.place < {LIMIT} AND NOT list_contains(p.taken, c.story_id)) q GROUP BY place, taken, sources, kinds) b""",
}


@query("g05_diversified_feed", "SELECT 'all' AS feed, CAST(place AS INTEGER) AS place, best.story_id, best.source, best.kind, round(best.score, 6) AS score, round(best.damped, 6) AS damped FROM picked WHERE place > 0", DIVERSE)
def diversified(spark, sf):
    stories, members, items, seen = rel(spark, sf, "stories", "story_items", "items", "interactions")
    pool = G.ranked(story_rows(spark, sf), NOW, G.pool_size(LIMIT)).select("story_id", "score")
    card_rows = G.cards(pool, stories, members, items, seen).select("story_id", "source", "kind")
    return G.diversify(pool.join(card_rows, "story_id"), LIMIT).withColumn("score", F.round("score", 6)).withColumn("damped", F.round("damped", 6))


@query("g06_lead_items", f"SELECT s.story_id, arg_min(i.item_id, ({RANK})) AS lead FROM story_items s JOIN items i ON i.item_id = s.item_id GROUP BY s.story_id")
def leads(spark, sf):
    members, items = rel(spark, sf, "story_items", "items")
    rows = members.join(items.select("item_id", "kind", "triage_score"), "item_id")
    return rows.groupBy("story_id").agg(F.min_by("item_id", G.lead_rank()).alias("lead"))


@query("g07_story_cards", "SELECT * FROM card", CARDS)
def cards(spark, sf):
    stories, members, items, seen = rel(spark, sf, "stories", "story_items", "items", "interactions")
    rows = G.cards(stories, stories, members, items, seen)
    return rows.withColumn("sources", F.array_join("sources", ","))


@query("g08_story_detail", "SELECT s.story_id, s.item_id, s.role, i.title, i.url, i.kind, i.source, i.author, i.published_s FROM story_items s JOIN items i ON i.item_id = s.item_id")
def detail(spark, sf):
    return G.detail(*rel(spark, sf, "story_items", "items"))


@query("g09_mark_seen", f"""
SELECT reader, story_id, action, count(*) AS n FROM (SELECT reader, story_id, action FROM interactions
  UNION ALL (SELECT -1, story_id, 'seen' FROM shown ORDER BY score DESC, story_id LIMIT {LIMIT})) x GROUP BY ALL""", WINDOWED)
def mark_seen(spark, sf):
    (seen,) = rel(spark, sf, "interactions")
    after = G.mark_seen(seen, G.ranked(story_rows(spark, sf), NOW, LIMIT), -1, NOW)
    return after.groupBy("reader", "story_id", "action").agg(F.count("*").alias("n"))


ENDS = {"ends": """SELECT s.story_id, arg_min(s.role, (i.at, i.item_id)) AS oldest_role, arg_min(i.source, (i.at, i.item_id)) AS oldest_source, min(i.at) AS oldest_at,
   arg_max(s.role, (i.at, i.item_id)) AS newest_role, arg_max(i.kind, (i.at, i.item_id)) AS newest_kind, max(i.at) AS newest_at
   FROM story_items s JOIN items i ON i.item_id = s.item_id GROUP BY s.story_id"""}


@query("g10_story_ends", "SELECT * FROM ends", ENDS)
def ends(spark, sf):
    rows = G.ends(*rel(spark, sf, "story_items", "items"))
    return rows.select("story_id", F.col("oldest.role").alias("oldest_role"), F.col("oldest.source").alias("oldest_source"), F.col("oldest.at").alias("oldest_at"),
                       F.col("newest.role").alias("newest_role"), F.col("newest.kind").alias("newest_kind"), F.col("newest.at").alias("newest_at"))


RENEWED = {**WINDOWED, **ENDS,
           "live": f"SELECT story_id, CAST(row_number() OVER (ORDER BY score DESC, story_id) AS INTEGER) AS position FROM shown QUALIFY position <= {LIMIT}",
           "deep": f"SELECT story_id, CAST(row_number() OVER (ORDER BY origin_score DESC, story_id) AS INTEGER) AS origin_position FROM shown QUALIFY origin_position <= {max(60, LIMIT * 3)}",
           "renewed": f"""SELECT l.story_id, position, origin_position, origin_position - position AS moved, (newest_at - oldest_at) / 3600.0 AS gap_hours,
              pow(2, (newest_at - oldest_at) / 3600.0 / 48) AS lift, newest_role AS renewed_role, coalesce(origin_position > {LIMIT}, true) AS carried
              FROM live l LEFT JOIN deep d ON d.story_id = l.story_id JOIN ends e ON e.story_id = l.story_id"""}


def _renewal(spark, sf):
    return G.renewal(story_rows(spark, sf), *rel(spark, sf, "story_items", "items"), NOW, LIMIT)


@query("g11_renewal", "SELECT story_id, position, origin_position, moved, round(gap_hours, 6) AS gap_hours, round(lift, 6) AS lift, renewed_role, carried FROM renewed", RENEWED)
def renewal(spark, sf):
    return _renewal(spark, sf).withColumn("gap_hours", F.round("gap_hours", 6)).withColumn("lift", F.round("lift", 6))


@query("g11_renewal_summary", """
SELECT count(*) AS stories, count(*) FILTER (gap_hours >= 1) AS renewed, count(*) FILTER (carried) AS carried,
  round(coalesce(median(gap_hours) FILTER (gap_hours >= 1), 0), 6) AS median_gap FROM renewed""", RENEWED)
def renewal_summary(spark, sf):
    return G.renewal_summary(_renewal(spark, sf)).withColumn("median_gap", F.round("median_gap", 6))


KEPT = {**AGG, **INHERITED, "kept_rows": f"""SELECT a.story_id, t.slug, a.newest, coalesce(s.keep_most, 6) AS cap FROM agg a LEFT JOIN story_topics t ON t.story_id = a.story_id LEFT JOIN settings s ON s.slug = t.slug
   WHERE {NOW} - a.newest <= coalesce(s.keep_days, 45) * 86400"""}


def _retained(spark, sf):
    homes, spine = rel(spark, sf, "story_topics", "spine")
    settings = R.inherited(spine, tree(spark, sf), DEFAULTS)
    return G.within_retention(story_rows(spark, sf, None), homes, settings, NOW, DEFAULTS["keep_days"]), settings


@query("g12_topic_retention", "SELECT story_id, slug, newest FROM kept_rows", KEPT)
def retention(spark, sf):
    return _retained(spark, sf)[0].select("story_id", "slug", "newest")


@query("g13_newest_per_topic", """
SELECT story_id, slug, newest FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY newest DESC, story_id) AS rn FROM kept_rows) x WHERE cap = 0 OR rn <= cap""", KEPT)
def newest_per_topic(spark, sf):
    rows, settings = _retained(spark, sf)
    largest = settings.agg(F.max("keep_most")).first()[0] or 0
    return G.newest_per_topic(rows, DEFAULTS["keep_most"], max(largest, DEFAULTS["keep_most"])).select("story_id", "slug", "newest")


@query("g14_engagement", f"SELECT s.story_id, max({POINTS_SQL}) AS points, max({COMMENTS_SQL}) AS comments FROM story_items s JOIN items i ON i.item_id = s.item_id GROUP BY s.story_id")
def engagement(spark, sf):
    return G.engagement(*rel(spark, sf, "story_items", "items"))


@query("g15_packed_centroids", "SELECT key AS story_id, array_to_string(list_transform(vec, lambda x: CAST(greatest(-127, least(127, round_even(x * 127, 0))) AS INTEGER)), ',') AS packed FROM centroids", CENTROIDS)
def packed(spark, sf):
    return G.packed_centroids(story_centroids(spark, sf)).select("story_id", F.array_join("packed", ",").alias("packed"))


@query("g16_stories_per_category", """
SELECT coalesce(CASE WHEN p.path = '' THEN p.slug ELSE split_part(p.path, '/', 1) END, '(none)') AS top, count(*) AS stories
FROM stories x LEFT JOIN story_topics t ON t.story_id = x.story_id LEFT JOIN paths p ON p.slug = t.slug GROUP BY 1""", TREE)
def per_category(spark, sf):
    stories, homes = rel(spark, sf, "stories", "story_topics")
    return G.by_top(stories, homes, R.paths(tree(spark, sf)))


@query("g17_spine_listing", """
SELECT s.slug, s.name, s.parent, p.name AS parent_name, CASE WHEN EXISTS (SELECT 1 FROM spine c WHERE c.parent = s.slug) THEN s.description END AS description
FROM spine s LEFT JOIN spine p ON p.slug = s.parent""")
def spine_listing(spark, sf):
    return R.listing(*rel(spark, sf, "spine"))


FACET_NAMES = [(slug, slug.capitalize()) for slug, _ in FACETS]
ISO = "strftime(make_timestamp(CAST({} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
BUNDLE = {
    **KEPT, **CARDS, **CENTROIDS, **ENTITY_SQL,
    "published": f"""SELECT story_id, slug, newest, score FROM (SELECT k.*, {score_sql('k.newest')} AS score, row_number() OVER (PARTITION BY k.slug ORDER BY k.newest DESC, k.story_id) AS rn
       FROM kept_rows k JOIN agg a ON a.story_id = k.story_id WHERE floor(k.newest / 86400) >= {(NOW - DAYS * 86400) // 86400}) x WHERE cap = 0 OR rn <= cap""",
    "said": f"SELECT story_id, string_agg({KIND_OF} || ':' || entity, ',' ORDER BY entity) AS entities FROM entity_hits GROUP BY story_id",
    "loud": f"SELECT s.story_id, max({POINTS_SQL}) AS points, max({COMMENTS_SQL}) AS comments FROM story_items s JOIN items i ON i.item_id = s.item_id GROUP BY s.story_id",
    "bytes": "SELECT key AS story_id, array_to_string(list_transform(vec, lambda x: printf('%02x', (256 + CAST(greatest(-127, least(127, round_even(x * 127, 0))) AS INTEGER)) % 256)), '') AS hex FROM centroids",
    "shelves": "SELECT DISTINCT parent AS slug FROM spine WHERE parent IS NOT NULL",
}


def bundle_lines(spark, sf):
    """The lines of the whole bundle, in its order."""
    stories, members, items, seen, homes, spine, sources = rel(spark, sf, "stories", "story_items", "items", "interactions", "story_topics", "spine", "sources")
    closed = tree(spark, sf)
    settings = R.inherited(spine, closed, DEFAULTS)
    rows = G.within_retention(G.scored(story_rows(spark, sf), NOW), homes, settings, NOW, DEFAULTS["keep_days"])
    chosen = G.newest_per_topic(rows, DEFAULTS["keep_most"], max(settings.agg(F.max("keep_most")).first()[0] or 0, DEFAULTS["keep_most"]))
    chosen = chosen.select("story_id", "newest", "score")
    labels = P.labels(homes, spine, R.paths(closed))
    kinds = F.create_map(*[F.lit(x) for kind, name, _ in ENTITIES for x in (name, kind)])
    entities = entity_matches(spark, sf).select("story_id", F.element_at(kinds, F.col("entity")).alias("kind"), F.col("entity").alias("name"))
    parts = [
        B.stories(chosen, G.cards(chosen, stories, members, items, seen), labels, entities, story_centroids(spark, sf), G.engagement(members, items)),
        B.story_items(chosen, members, items), B.status(items, stories, sources), B.spine(spine),
        B.facets(spark.createDataFrame(FACET_NAMES, "slug string, name string")), B.vectors(spark, DIMENSION),
    ]
    return B.newest_first(reduce(DataFrame.unionByName, parts))


@query("a22_bundle", f"""
SELECT 'story' AS section, p.story_id, c.kind, c.title, c.url, c.source, {ISO.format('c.published_s')} AS published_at, t.slug, t.name, t.parent, u.name AS parent_name,
  c.summary, c.sources, {ISO.format('p.newest')} AS last_activity, round(p.score, 4) AS score, c.item_count, c.media_url, to_base64(from_hex(b.hex)) AS centroid, x.path,
  coalesce(e.entities, '') AS entities, l.points, l.comments, NULL::VARCHAR AS description, NULL::VARCHAR AS error, NULL::BIGINT AS stories, NULL::VARCHAR AS newest_item,
  NULL::BIGINT AS kept, NULL::BIGINT AS rejected, NULL::BIGINT AS pending, NULL::VARCHAR AS encoding, NULL::BIGINT AS dimension, NULL::BIGINT AS scale
FROM published p JOIN card c ON c.story_id = p.story_id LEFT JOIN spine t ON t.slug = p.slug LEFT JOIN spine u ON u.slug = t.parent LEFT JOIN paths x ON x.slug = t.slug
LEFT JOIN said e ON e.story_id = p.story_id LEFT JOIN loud l ON l.story_id = p.story_id LEFT JOIN bytes b ON b.story_id = p.story_id
UNION ALL BY NAME SELECT 'items' AS section, p.story_id, i.kind, i.title, i.url, i.source, {ISO.format('i.published_s')} AS published_at FROM published p JOIN story_items s ON s.story_id = p.story_id JOIN items i ON i.item_id = s.item_id
UNION ALL BY NAME SELECT 'status' AS section, (SELECT count(*) FROM stories) AS stories, {ISO.format('max(i.at)')} AS newest_item, count(*) FILTER (triage_state = 'kept') AS kept,
  count(*) FILTER (triage_state = 'rejected') AS rejected, count(*) FILTER (triage_state = 'pending') AS pending FROM items i
UNION ALL BY NAME SELECT 'broken' AS section, name, last_error AS error FROM sources WHERE enabled AND last_error IS NOT NULL
UNION ALL BY NAME SELECT 'spine' AS section, s.slug, s.name, s.parent, u.name AS parent_name, CASE WHEN s.slug IN (SELECT slug FROM shelves) THEN s.description END AS description FROM spine s LEFT JOIN spine u ON u.slug = s.parent
UNION ALL BY NAME SELECT 'facets' AS section, slug, name FROM (VALUES {', '.join(f"('{s}', '{n}')" for s, n in FACET_NAMES)}) f(slug, name)
UNION ALL BY NAME SELECT 'vectors' AS section, 'int8' AS encoding, max(len(embedding)) AS dimension, 127 AS scale FROM vectors""", BUNDLE)
def bundle(spark, sf):
    folder = scratch(spark, "bundle")
    bundles.write(bundle_lines(spark, sf), folder, generated_at="2024-03-01T00:00:00Z")
    return B.rows(bundles.read(spark, folder))


@query("a23_relations", " UNION ALL ".join(f"SELECT '{name}' AS relation, count(*) AS n FROM {name}" for name in RELATIONS))
def relations(spark, sf):
    counts = [relation(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("relation"), "n") for n in RELATIONS]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
