"""Topics, facets and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import vectors as V
from storyloom.model import NOW, relation, spread_relation, table
from storyloom.operators import labels as L
from storyloom.operators import subjects as S
from storyloom.operators import topics as P
from storyloom.operators import tree as R
from storyloom.operators.scoring import with_best
from storyloom.plans.registry import query
from storyloom.plans.similarity import means_sql, reference_vectors

FLOOR, FALLBACK, MARGIN = 0.18, 0.10, 0.03
CLAIMS = [("leaf-3", r"^ (?: la | le | les ) \b   # an opening article"), ("leaf-7", r"\b der \b")]
TREE = {
    "tree": """WITH RECURSIVE up AS (SELECT slug, slug AS ancestor, 0 AS distance FROM spine
       UNION ALL SELECT u.slug, s.parent, u.distance + 1 FROM up u JOIN spine s ON s.slug = u.ancestor WHERE s.parent IS NOT NULL) SELECT * FROM up""",
    "paths": "SELECT slug, coalesce(array_to_string(list(ancestor ORDER BY distance DESC) FILTER (distance > 0), '/'), '') AS path FROM tree GROUP BY slug",
}
CENTROIDS = {"centroids": means_sql("story_id", source="(SELECT s.story_id, v.embedding FROM story_items s JOIN vectors v ON v.item_id = s.item_id)")}
FILING = {
    **CENTROIDS,
    "leaf_vec": means_sql("label"),
    "top_vec": means_sql("label % 5"),
    "leaf_scores": """SELECT c.key AS story_id, l.key AS leaf, list_dot_product(c.vec, l.vec) AS s,
        row_number() OVER (PARTITION BY c.key ORDER BY list_dot_product(c.vec, l.vec) DESC, l.key) AS place FROM centroids c, leaf_vec l""",
    "top_scores": """SELECT c.key AS story_id, t.key AS top, list_dot_product(c.vec, t.vec) AS s,
        row_number() OVER (PARTITION BY c.key ORDER BY list_dot_product(c.vec, t.vec) DESC, t.key) AS place FROM centroids c, top_vec t""",
    "heads": "SELECT s.story_id, arg_min(i.title, (i.at, i.item_id)) AS title, arg_min(i.kind, (i.at, i.item_id)) AS kind FROM story_items s JOIN items i ON i.item_id = s.item_id GROUP BY s.story_id",
    "claim": r"""SELECT story_id, CASE WHEN kind = 'paper' THEN NULL WHEN regexp_matches(title, '(?i)^(la|le|les)([^\pL\pN_]|$)') THEN 'leaf-3'
        WHEN regexp_matches(title, '(?i)(^|[^\pL\pN_])der([^\pL\pN_]|$)') THEN 'leaf-7' END AS claim FROM heads""",
    "filed": f"""SELECT a.story_id, c.claim, CASE WHEN c.claim IS NOT NULL THEN 'claimed|' || c.claim
        WHEN a.s >= {FLOOR} AND pa.parent = pb.parent AND a.s - b.s < {MARGIN} THEN 'parked|' || pa.parent
        WHEN a.s >= {FLOOR} AND u.s > a.s THEN 'category|' || pa.parent
        WHEN a.s >= {FLOOR} THEN 'leaf|leaf-' || a.leaf
        WHEN t.s >= {FALLBACK} THEN 'category|region-' || t.top ELSE 'unmatched|' END AS d, a.s - b.s AS margin
      FROM leaf_scores a JOIN leaf_scores b ON b.story_id = a.story_id AND b.place = 2 JOIN top_scores t ON t.story_id = a.story_id AND t.place = 1
      JOIN spine pa ON pa.slug = 'leaf-' || a.leaf JOIN spine pb ON pb.slug = 'leaf-' || b.leaf
      LEFT JOIN top_scores u ON u.story_id = a.story_id AND 'region-' || u.top = pa.parent
      LEFT JOIN claim c ON c.story_id = a.story_id WHERE a.place = 1""",
}


def story_centroids(spark, sf):
    return P.centroids(relation(spark, sf, "story_items"), relation(spark, sf, "vectors"))


def _leaves(spark, sf):
    return reference_vectors(spark, sf, "'leaf-' || label")


def _tops(spark, sf):
    return reference_vectors(spark, sf, "'region-' || label % 5")


def _spine(spark, sf):
    return relation(spark, sf, "spine").select("slug", "parent")


def filed(spark, sf, claims=True):
    heads = P.headlines(relation(spark, sf, "story_items"), relation(spark, sf, "items")) if claims else None
    return P.assign(story_centroids(spark, sf), heads, _leaves(spark, sf), _tops(spark, sf), _spine(spark, sf), CLAIMS if claims else [],
                    FLOOR, FALLBACK, MARGIN)


def ranked_leaves(spark, sf, n=None):
    """(story_id, centroid, leaf): the ``n`` best leaves of every story, all of them for None."""
    return with_best(story_centroids(spark, sf), "story_id", "centroid", _leaves(spark, sf), n, "leaf")


def tree(spark, sf):
    return R.closure(relation(spark, sf, "spine"))


@query("f01_story_centroids", "SELECT key AS story_id, pos, round(v, 6) AS value FROM (SELECT key, unnest(vec) AS v, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos FROM centroids) x", CENTROIDS)
def centroids(spark, sf):
    each = story_centroids(spark, sf).select("story_id", F.posexplode("centroid").alias("pos", "value"))
    return each.withColumn("value", F.round("value", 6))


@query("f02_leaf_scores", "SELECT story_id, 'leaf-' || leaf AS leaf, round(s, 6) AS score FROM leaf_scores", FILING)
def leaf_scores(spark, sf):
    each = ranked_leaves(spark, sf).select("story_id", F.explode("leaf").alias("l"))
    return each.select("story_id", F.col("l.key").alias("leaf"), F.round("l.score", 6).alias("score"))


@query("f03_headlines", "SELECT story_id, title, kind FROM heads", FILING)
def headlines(spark, sf):
    return P.headlines(relation(spark, sf, "story_items"), relation(spark, sf, "items"))


@query("f04_headline_claims", "SELECT story_id, claim FROM claim WHERE claim IS NOT NULL", FILING)
def claims(spark, sf):
    heads = P.headlines(relation(spark, sf, "story_items"), relation(spark, sf, "items"))
    return heads.select("story_id", P.claimed(F.col("title"), F.col("kind"), CLAIMS).alias("claim")).where("claim IS NOT NULL")


@query("f05_home_by_best_fit", f"""
SELECT a.story_id, CASE WHEN a.s < {FLOOR} THEN NULL WHEN pa.parent = pb.parent AND a.s - b.s < {MARGIN} THEN pa.parent ELSE 'leaf-' || a.leaf END AS home,
   CASE WHEN a.s < {FLOOR} THEN 'unmatched' WHEN pa.parent = pb.parent AND a.s - b.s < {MARGIN} THEN 'parked' ELSE 'leaf' END AS how
FROM leaf_scores a JOIN leaf_scores b ON b.story_id = a.story_id AND b.place = 2 JOIN spine pa ON pa.slug = 'leaf-' || a.leaf JOIN spine pb ON pb.slug = 'leaf-' || b.leaf WHERE a.place = 1""", FILING)
def best_fit(spark, sf):
    rows = P.assign(story_centroids(spark, sf), None, _leaves(spark, sf), None, _spine(spark, sf), [], FLOOR, FALLBACK, MARGIN)
    return rows.select("story_id", "home", "how")


@query("f06_category_fallback", f"SELECT story_id, 'region-' || top AS category, round(s, 6) AS score FROM top_scores WHERE place = 1 AND s >= {FALLBACK} AND story_id IN (SELECT story_id FROM leaf_scores WHERE place = 1 AND s < {FLOOR})", FILING)
def fallback(spark, sf):
    rows = with_best(ranked_leaves(spark, sf, 1), "story_id", "centroid", _tops(spark, sf), 1, "top")
    best = F.get("top", F.lit(0))
    rows = rows.where((F.get("leaf", F.lit(0))["score"] < FLOOR) & (best["score"] >= FALLBACK))
    return rows.select("story_id", best["key"].alias("category"), F.round(best["score"], 6).alias("score"))


@query("f07_category_contest", f"""
SELECT a.story_id, pa.parent AS category, u.s > a.s AS wins FROM leaf_scores a JOIN spine pa ON pa.slug = 'leaf-' || a.leaf
JOIN top_scores u ON u.story_id = a.story_id AND 'region-' || u.top = pa.parent WHERE a.place = 1 AND a.s >= {FLOOR}""", FILING)
def contest(spark, sf):
    best = F.get("leaf", F.lit(0))
    rows = ranked_leaves(spark, sf, 1).select("story_id", "centroid", best["key"].alias("slug"), best["score"].alias("s")).where(F.col("s") >= FLOOR)
    rows = rows.join(_spine(spark, sf), "slug").join(_tops(spark, sf).withColumnRenamed("key", "parent"), "parent")
    return rows.select("story_id", F.col("parent").alias("category"), (V.dot(F.col("centroid"), F.col("vector")) > F.col("s")).alias("wins"))


@query("f08_topic_assignment", "SELECT story_id, nullif(split_part(d, '|', 2), '') AS home, split_part(d, '|', 1) AS how FROM filed", FILING)
def assignment(spark, sf):
    return filed(spark, sf).select("story_id", "home", "how")


@query("f08_topic_totals", "SELECT split_part(d, '|', 1) AS how, nullif(split_part(d, '|', 2), '') AS home, count(*) AS n FROM filed GROUP BY 1, 2", FILING)
def assignment_totals(spark, sf):
    return P.run_totals(filed(spark, sf))


@query("f09_tree_closure", "SELECT slug, ancestor, CAST(distance AS INTEGER) AS distance FROM tree", TREE)
def closure(spark, sf):
    return tree(spark, sf)


@query("f09_tree_paths", "SELECT p.slug, p.path, NOT EXISTS (SELECT 1 FROM spine c WHERE c.parent = p.slug) AS is_leaf FROM paths p", TREE)
def paths(spark, sf):
    spine = relation(spark, sf, "spine")
    leaf = R.leaves(spine).select("slug", F.lit(True).alias("leaf"))
    rows = R.paths(tree(spark, sf)).join(leaf, "slug", "left")
    return rows.select("slug", F.array_join("path", "/").alias("path"), F.coalesce("leaf", F.lit(False)).alias("is_leaf"))


INHERITED = {**TREE, "settings": """SELECT t.slug, coalesce(arg_min(s.keep_days, t.distance) FILTER (s.keep_days IS NOT NULL), 45) AS keep_days,
   coalesce(arg_min(s.keep_most, t.distance) FILTER (s.keep_most IS NOT NULL), 6) AS keep_most FROM tree t JOIN spine s ON s.slug = t.ancestor GROUP BY t.slug"""}
DEFAULTS = {"keep_days": 45, "keep_most": 6}


@query("f10_inherited_settings", "SELECT slug, CAST(keep_days AS INTEGER) AS keep_days, CAST(keep_most AS INTEGER) AS keep_most FROM settings", INHERITED)
def inherited(spark, sf):
    return R.inherited(relation(spark, sf, "spine"), tree(spark, sf), DEFAULTS)


@query("f11_story_labels", """
SELECT st.story_id, s.slug, s.name, s.parent, p.name AS parent_name, x.path FROM story_topics st JOIN spine s ON s.slug = st.slug
LEFT JOIN spine p ON p.slug = s.parent JOIN paths x ON x.slug = s.slug""", TREE)
def story_labels(spark, sf):
    spine = relation(spark, sf, "spine")
    rows = P.labels(relation(spark, sf, "story_topics"), spine, R.paths(tree(spark, sf)))
    return rows.select("story_id", "slug", "name", "parent", "parent_name", F.array_join("path", "/").alias("path"))


@query("f12_topic_stats", """
SELECT s.slug, s.name, count(t.story_id) AS stories, count(t.story_id) FILTER (NOT EXISTS (SELECT 1 FROM story_items si JOIN items i ON i.item_id = si.item_id
   WHERE si.story_id = t.story_id AND i.triage_state = 'kept')) AS below_triage, max(x.last_activity) AS newest
FROM spine s LEFT JOIN story_topics t ON t.slug = s.slug LEFT JOIN stories x ON x.story_id = t.story_id GROUP BY s.slug, s.name""")
def topic_stats(spark, sf):
    return P.stats(*[relation(spark, sf, n) for n in ("spine", "story_topics", "stories", "story_items", "items")])


@query("f13_topics_by_source", f"""
SELECT source, filed, count(*) AS stories FROM (SELECT DISTINCT i.source, x.story_id, coalesce(array_to_string(string_split(CASE WHEN p.path = '' THEN p.slug ELSE p.path || '/' || p.slug END, '/')[1:3], '/'), '(none)') AS filed
 FROM stories x JOIN story_items si ON si.story_id = x.story_id JOIN items i ON i.item_id = si.item_id LEFT JOIN story_topics t ON t.story_id = x.story_id LEFT JOIN paths p ON p.slug = t.slug
 WHERE x.last_activity >= {NOW} - 20 * 86400) y GROUP BY source, filed""", TREE)
def topics_by_source(spark, sf):
    rel = lambda n: relation(spark, sf, n)
    return P.by_source(rel("stories"), rel("story_items"), rel("items"), rel("story_topics"), R.paths(tree(spark, sf)), NOW, 20)


@query("f14_topic_explain", """
SELECT f.story_id, nullif(split_part(f.d, '|', 2), '') AS home, t.slug AS stored, round(f.margin, 6) AS margin, CAST(l.place AS INTEGER) AS place, 'leaf-' || l.leaf AS leaf, round(l.s, 6) AS score
FROM filed f JOIN leaf_scores l ON l.story_id = f.story_id LEFT JOIN story_topics t ON t.story_id = f.story_id""", FILING)
def topic_explain(spark, sf):
    rows = P.explain(filed(spark, sf), ranked_leaves(spark, sf), relation(spark, sf, "story_topics"))
    return rows.withColumn("margin", F.round("margin", 6)).withColumn("score", F.round("score", 6))


@query("f15_find_story", """
SELECT k.key, s.story_id FROM (SELECT CAST(doc_id AS VARCHAR) AS key, doc_id FROM @labels) k JOIN stories s ON s.story_id = k.doc_id
UNION ALL SELECT key, arg_max(si.story_id, (i.at, i.item_id)) FROM (SELECT n_name AS key FROM @nation UNION ALL SELECT 'THE E' UNION ALL SELECT 'eux') k
  JOIN items i ON contains(lower(i.title), lower(k.key)) JOIN story_items si ON si.item_id = i.item_id GROUP BY key""")
def find_story(spark, sf):
    numbers = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))
    texts = table(spark, sf, "nation").select(F.col("n_name").alias("key")).unionByName(
        spark.createDataFrame([("THE E",), ("eux",)], "key string"))
    rel = lambda n: relation(spark, sf, n)
    return P.find_story(numbers.unionByName(texts), rel("stories"), rel("story_items"), rel("items"))


TEXTS = {"texts": "SELECT s.story_id, s.item_id, coalesce(i.title, '') || ' ' || coalesce(i.summary, '') AS text FROM story_items s JOIN items i ON i.item_id = s.item_id"}
FACETS = [("agents", r"\bder\b|\bdie\b"), ("benchmark", r"mentre"), ("open", r"\bof (the|and)\b"), ("code", r"tions?\b"), ("safety", r"éle")]
ENTITIES = [("model", "On", ["Oneat"]), ("org", "Le", ["La Aux"]), ("tool", "Der", []), ("person", "Ere.Th", ["Ist"])]


def texts(spark, sf):
    return L.member_texts(relation(spark, sf, "story_items"), spread_relation(spark, sf, "items", "item_id"))


def facet_matches(spark, sf):
    return L.match(texts(spark, sf), L.facet_patterns(FACETS), "facet")


def entity_matches(spark, sf):
    patterns = [(name, L.entity_pattern([name, *aliases])) for _, name, aliases in ENTITIES]
    return L.match(texts(spark, sf), patterns, "entity")


NB, NA = r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"
FACET_SQL = {**TEXTS, "facet_hits": " UNION ".join(
    f"SELECT story_id, '{slug}' AS facet FROM texts WHERE regexp_matches(text, '(?i){p}')" for slug, p in (
        ("agents", f"{NB}(der|die){NA}"), ("benchmark", "mentre"), ("open", f"{NB}of (the|and){NA}"), ("code", f"tions?{NA}"), ("safety", "éle")))}
# A whole name: not after a word or a dotted word, not before a word or a dot and a word.
EB, EA = r"(^|[^\pL\pN_.]|(^|[^\pL\pN_])\.)", r"($|[^\pL\pN_.]|\.($|[^\pL\pN_]))"
ENTITY_SQL = {**TEXTS, "entity_hits": " UNION ".join(
    f"SELECT story_id, '{name}' AS entity FROM texts WHERE regexp_matches(text, '(?i){EB}({p}){EA}')" for name, p in (
        ("On", "Oneat|On"), ("Le", "La Aux|Le"), ("Der", "Der"), ("Ere.Th", r"Ere\.Th|Ist")))}


@query("f17_story_texts", "SELECT story_id, item_id, text FROM texts", TEXTS)
def story_texts(spark, sf):
    return texts(spark, sf)


@query("f18_facet_matches", "SELECT story_id, facet FROM facet_hits", FACET_SQL)
def facets(spark, sf):
    return facet_matches(spark, sf)


@query("f19_facet_counts", "SELECT facet, count(*) AS stories FROM facet_hits GROUP BY facet UNION ALL SELECT '(any)', count(DISTINCT story_id) FROM facet_hits", FACET_SQL)
def facet_counts(spark, sf):
    return L.counts(facet_matches(spark, sf), "facet")


@query("f20_facets_per_story", "SELECT story_id, string_agg(facet, ',' ORDER BY facet) AS facets FROM facet_hits GROUP BY story_id", FACET_SQL)
def facets_per_story(spark, sf):
    return L.per_story(facet_matches(spark, sf), "facet").select("story_id", F.array_join("labels", ",").alias("facets"))


@query("f21_entity_matches", "SELECT story_id, entity FROM entity_hits", ENTITY_SQL)
def entities(spark, sf):
    return entity_matches(spark, sf)


@query("f22_entity_sync", """
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.name, b.name) AS name, coalesce(b.aliases, a.aliases) AS aliases
FROM (SELECT 'org' AS kind, p_name AS name, min(p_type) AS aliases FROM @part GROUP BY p_name) a
FULL OUTER JOIN (SELECT 'org' AS kind, p_name AS name, min(p_brand) AS aliases FROM @part WHERE p_size % 3 = 0 GROUP BY p_name UNION ALL SELECT 'tool', s_name, 'x' FROM @supplier) b ON a.kind = b.kind AND a.name = b.name""")
def entity_sync(spark, sf):
    part = table(spark, sf, "part")
    stored = part.groupBy(F.lit("org").alias("kind"), F.col("p_name").alias("name")).agg(F.min("p_type").alias("aliases"))
    seeded = part.where("p_size % 3 = 0").groupBy(F.lit("org").alias("kind"), F.col("p_name").alias("name")).agg(F.min("p_brand").alias("aliases"))
    tools = table(spark, sf, "supplier").select(F.lit("tool").alias("kind"), F.col("s_name").alias("name"), F.lit("x").alias("aliases"))
    return L.sync_entities(stored, seeded.unionByName(tools))


KIND_OF = "CASE entity WHEN 'On' THEN 'model' WHEN 'Le' THEN 'org' WHEN 'Der' THEN 'tool' ELSE 'person' END"


@query("f23_entities_per_story", f"SELECT story_id, string_agg({KIND_OF} || ':' || entity, ',' ORDER BY entity) AS entities FROM entity_hits GROUP BY story_id", ENTITY_SQL)
def entities_per_story(spark, sf):
    kinds = {name: kind for kind, name, _ in ENTITIES}
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    rows = L.per_story(entity_matches(spark, sf), "entity")
    return rows.select("story_id", F.array_join(F.transform("labels", lambda e: F.concat(F.element_at(named, e), F.lit(":"), e)), ",").alias("entities"))


@query("f24_entity_stats", f"""
SELECT e.kind, e.name, count(h.story_id) AS stories FROM (VALUES {', '.join(f"('{k}', '{n}')" for k, n, _ in ENTITIES)}) e(kind, name)
LEFT JOIN entity_hits h ON h.entity = e.name GROUP BY e.kind, e.name""", ENTITY_SQL)
def entity_stats(spark, sf):
    rows = spark.createDataFrame([(k, n) for k, n, _ in ENTITIES], "kind string, name string")
    return L.entity_stats(rows, entity_matches(spark, sf))


EDGE = r"\[\](){}\"''“”‘’,:;!?"
MINING = {
    "recent_members": f"SELECT s.story_id, i.item_id, i.title, coalesce(i.summary, '') AS summary FROM stories x JOIN story_items s ON s.story_id = x.story_id JOIN items i ON i.item_id = s.item_id WHERE floor(x.last_activity / 86400) >= {(NOW - 30 * 86400) // 86400}",
    # A break is put after every sentence end, the text then cut at the breaks.
    "sentences": r"SELECT story_id, item_id, unnest(string_split(regexp_replace(summary, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(summary, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS sn FROM recent_members",
    "raws": r"SELECT story_id, item_id, sn, unnest(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')) AS raw, generate_subscripts(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> ''), 1) AS place FROM sentences",
    "tok": f"SELECT *, regexp_replace(raw, '^[{EDGE}]+|[{EDGE}]+$', '', 'g') AS word, regexp_matches(raw, '[{EDGE}]$') AS marked FROM raws",
    "words": """SELECT *, CASE WHEN place > 1 AND NOT lag(marked) OVER w THEN lag(word) OVER w ELSE '' END AS previous FROM tok WINDOW w AS (PARTITION BY item_id, sn ORDER BY place)""",
    "named": rf"SELECT * FROM words WHERE place > 1 AND regexp_matches(word, '^{L.PROPER}$')",
    "cap": "SELECT word, count(*) AS times FROM named GROUP BY word",
    "low": rf"SELECT word AS low, count(*) AS low_times FROM words WHERE word <> '' AND NOT (place > 1 AND regexp_matches(word, '^{L.PROPER}$')) AND word = lower(word) AND word <> upper(word) GROUP BY word",
    "pre": rf"SELECT word, max((n, previous)) AS b FROM (SELECT word, previous, count(*) AS n FROM named WHERE regexp_matches(previous, '^{L.PROPER}$') GROUP BY word, previous) x GROUP BY word",
    "spread": rf"SELECT word, count(DISTINCT story_id) AS stories FROM (SELECT story_id, unnest(regexp_extract_all(title, '{L.PROPER}')) AS word FROM recent_members UNION ALL SELECT story_id, word FROM named) x GROUP BY word",
    "often": rf"""SELECT c.word, c.times, s.stories, p.b[1] AS n, p.b[2] AS prefix FROM cap c JOIN spread s ON s.word = c.word LEFT JOIN low l ON l.low = lower(c.word) LEFT JOIN pre p ON p.word = c.word
      WHERE s.stories >= 3 AND length(c.word) >= 3 AND lower(c.word) NOT IN ('abstract','announce','type','tags','however','english','chinese','we','our')
        AND coalesce(l.low_times, 0) <= c.times / 4 AND lower(c.word) NOT IN ('on', 'oneat', 'le', 'la aux', 'der', 'ere.th', 'ist')
        AND NOT (regexp_matches(split_part(c.word, '-', 1), '^[A-Z]+s?$'))""",
    "holders": rf"SELECT story_id, item_id, title, unnest(regexp_extract_all(title, '{L.PROPER}')) AS word FROM recent_members UNION ALL SELECT n.story_id, n.item_id, m.title, n.word FROM named n JOIN recent_members m ON m.item_id = n.item_id",
    "examples": f"""SELECT word, array_to_string(list(title ORDER BY story_id, item_id, title)[1:{L.EXAMPLE_TITLES}], ' | ') AS titles FROM (
      SELECT word, title, min((story_id, item_id))[1] AS story_id, min((story_id, item_id))[2] AS item_id FROM holders WHERE title <> '' GROUP BY word, title) x GROUP BY word""",
}


@query("f25_name_mining", """
SELECT CASE WHEN o.n * 2 >= o.times AND lower(o.prefix) NOT IN ('abstract','announce','type','tags','however','english','chinese','we','our') AND coalesce(l.low_times, 0) <= o.n / 4
  THEN o.prefix || ' ' || o.word ELSE o.word END AS name, o.stories, coalesce(x.titles, '') AS examples FROM often o LEFT JOIN low l ON l.low = lower(o.prefix) LEFT JOIN examples x ON x.word = o.word
ORDER BY stories DESC, name, o.word LIMIT 15""", MINING)
def name_mining(spark, sf):
    rel = lambda n: relation(spark, sf, n)
    known = [[name, *aliases] for _, name, aliases in ENTITIES]
    found = L.mine_names(rel("story_items"), spread_relation(spark, sf, "items", "item_id"), rel("stories"), known, (NOW - 30 * 86400) // 86400)
    return found.withColumn("examples", F.array_join("examples", " | "))


@query("f26_spine_sync", """
SELECT coalesce(a.slug, c.slug) AS slug, coalesce(c.name, a.name) AS name, CASE WHEN c.slug IS NULL THEN a.parent ELSE c.parent END AS parent
FROM (SELECT * FROM spine WHERE ord < 1000) a FULL OUTER JOIN (SELECT slug, name || '!' AS name, CASE WHEN ord % 2 = 0 THEN parent END AS parent FROM spine WHERE ord >= 3) c ON c.slug = a.slug""")
def spine_sync(spark, sf):
    spine = relation(spark, sf, "spine")
    wanted = spine.where("ord >= 3").select("slug", F.concat("name", F.lit("!")).alias("name"), F.when(F.col("ord") % 2 == 0, F.col("parent")).alias("parent"))
    return P.sync_spine(spine.where("ord < 1000").select("slug", "name", "parent"), wanted)


SUBJECT_DAYS, SUBJECT_FLOOR = 30, 0.35


def subject_homes(spark, sf):
    recent = relation(spark, sf, "stories").where(I.in_day_window(F.col("last_activity"), NOW, SUBJECT_DAYS)).select("story_id", F.col("last_activity").alias("newest"))
    return S.groups(recent.join(story_centroids(spark, sf), "story_id"), SUBJECT_FLOOR)


@query("f16_subject_groups")
def subject_groups(spark, sf):
    return S.candidates(subject_homes(spark, sf), *[relation(spark, sf, n) for n in ("story_topics", "spine")])


@query("f16_subject_topics")
def subject_topics(spark, sf):
    return S.covered(subject_homes(spark, sf), relation(spark, sf, "story_topics"))
