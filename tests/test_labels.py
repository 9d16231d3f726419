"""Filing, trees, retention, mining and ingest on literal rows."""

import numpy as np
from pyspark.sql import functions as F

from storyloom.functions import vectors
from storyloom.operators import feed, graph, ingest, labels, readers, topics, triage
from storyloom.operators import tree as R

AXES = np.eye(4)


def references(spark, keys, matrix):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in zip(keys, matrix)], "key string, vector array<double>")


def filed(spark, vectors, claims=(), heads=None):
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "story_id long, centroid array<double>")
    spine = spark.createDataFrame([("a", "top"), ("b", "top"), ("c", "other"), ("top", None)], "slug string, parent string")
    got = topics.assign(rows, heads, references(spark, "abc", AXES[:3]), references(spark, ["top"], AXES[3:4]), spine, list(claims), 0.55, 0.5, 0.02)
    return {r["story_id"]: (r["home"], r["how"]) for r in got.collect()}


def test_home_rules(spark):
    got = filed(spark, [
        [1, 0, 0, 0],              # plainly a
        [0.70, 0.69, 0, 0],        # a and b too close: their shelf
        [0.70, 0, 0.69, 0],        # close, but not on one shelf
        [0.1, 0.1, 0.1, 0.2],      # nothing fits
        [0.1, 0.1, 0.1, 0.6],      # no leaf, but the category
        [0.6, 0, 0, 0.7],          # the category beats its own leaf
        [0, 0, 0.6, 0.7],          # c is not under it
    ])
    assert got == {0: ("a", "leaf"), 1: ("top", "parked"), 2: ("a", "leaf"), 3: (None, "unmatched"), 4: ("top", "category"), 5: ("top", "category"), 6: ("c", "leaf")}


def test_claims_use_the_conditional_dialect_and_skip_papers(spark):
    heads = spark.createDataFrame([(0, "Introducing Foo 5 today and more words here", "article"), (1, "Foo 5", "post"), (2, "Foo 5", "paper"), (3, "About Foo 5 and more", "post")], "story_id long, title string, kind string")
    pattern = r"^ (?P<launch> introducing \s+ )? foo \s \d (?(launch) | \s* $ )   # bare, it must be all of the title"
    got = filed(spark, [[0, 0, 1, 0]] * 4, [("b", pattern)], heads)
    assert [got[i] for i in range(4)] == [("b", "claimed"), ("b", "claimed"), ("c", "leaf"), ("c", "leaf")]


def test_tree_closure_ends_on_a_cycle_and_inherits(spark):
    spine = spark.createDataFrame([("a", None, 9), ("b", "a", None), ("c", "b", 0), ("x", "y", None), ("y", "x", None)], "slug string, parent string, keep_days int")
    tree = R.closure(spine)
    assert {(r["slug"], r["ancestor"], r["distance"]) for r in tree.collect()} >= {("c", "a", 2), ("x", "y", 1), ("y", "x", 1)}
    assert {r["slug"]: r["keep_days"] for r in R.inherited(spine, tree, {"keep_days": 4}).collect()} == {"a": 9, "b": 9, "c": 0, "x": 4, "y": 4}
    assert {r["slug"]: list(r["path"]) for r in R.paths(tree).collect()}["c"] == ["a", "b"]


def test_closure_of_a_long_chain_and_of_many_cycles(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(1200)]
    rings = [(f"r{k}-{i}", f"r{k}-{(i + 1) % (k + 1)}") for k in range(40) for i in range(k + 1)]
    tails = [(f"t{k}", f"r{k}-0") for k in range(40)] + [("lost", "nowhere")]
    spine = spark.createDataFrame(chain + rings + tails, "slug string, parent string")
    tree = R.closure(spine).cache()
    assert tree.where("slug LIKE 'n%'").count() == 1200 * 1201 // 2
    assert tree.where("slug = 'n1199'").agg(F.max("distance")).first()[0] == 1199
    parent, want = dict(chain + rings + tails), set()
    for slug, _ in rings + tails:
        at, passed = slug, []
        while at in parent and at not in passed:
            want.add((slug, at, len(passed)))
            passed.append(at)
            at = parent[at]
    assert {tuple(r) for r in tree.where("slug NOT LIKE 'n%'").collect()} == want


def test_newest_per_topic_keeps_uncapped_topics_whole(spark):
    rows = spark.createDataFrame([(i, "hot", i, 2) for i in range(50)] + [(100 + i, "all", i, 0) for i in range(40)] + [(200, None, 1, None)],
                                 "story_id long, slug string, newest long, keep_most int")
    got = feed.newest_per_topic(rows, 6, 6).groupBy("slug").count().collect()
    assert {r["slug"]: r["count"] for r in got} == {"hot": 2, "all": 40, None: 1}


def test_facets_match_any_member(spark):
    texts = spark.createDataFrame([(1, "the agents came"), (1, "nothing"), (2, "reagent")], "story_id long, text string")
    got = labels.match(texts, labels.facet_patterns([("agents", r"\bagent(s|ic)?\b")]), "facet").collect()
    assert [(r["story_id"], r["facet"]) for r in got] == [(1, "agents")]


def test_name_mining(spark):
    summaries = ["we saw the Gemini Flash model and the Learning of it", "they ran Gemini Flash while learning, learning", "again Gemini Flash beat LLM and learning"]
    items = spark.createDataFrame([(i, f"Title {i}", s) for i, s in enumerate(summaries)], "item_id long, title string, summary string")
    members = spark.createDataFrame([(i, i, "seed") for i in range(3)], "story_id long, item_id long, role string")
    stories = spark.createDataFrame([(i, 100 * 86400) for i in range(3)], "story_id long, last_activity long")
    got = [(r["name"], r["stories"]) for r in labels.mine_names(members, items, stories, [["Claude"]], 0).collect()]
    assert got == [("Gemini", 3), ("Gemini Flash", 3)]
    seeded = [r["name"] for r in labels.mine_names(members, items, stories, [["Gemini", "Gemini Flash"]], 0).collect()]
    assert seeded == ["Flash"] or seeded == []


def test_mined_names_show_the_first_two_titles_they_were_met_under(spark):
    rows = [(0, "", "saw the Astra model"), (1, "same", "saw the Astra model"), (2, "same", "saw the Astra model"), (3, None, "saw the Astra model"), (4, "of Astra", None), (5, "third", "saw the Astra model")]
    items = spark.createDataFrame(rows, "item_id long, title string, summary string")
    members = spark.createDataFrame([(5 - i, i, "seed") for i in range(5)] + [(9, 5, "seed")], "story_id long, item_id long, role string")
    stories = spark.createDataFrame([(i, 100 * 86400) for i in range(10)], "story_id long, last_activity long")
    got = {r["name"]: r["examples"] for r in labels.mine_names(members, items, stories, [["Claude"]], 0).collect()}
    assert got == {"Astra": ["of Astra", "same"]}


def test_a_busy_source_brings_three_hundred_items_a_week(spark):
    week, rows = 7 * 86400, []
    for source, n, age in (("busy", 300, 1), ("calm", 299, 1), ("was busy", 400, week)):
        rows += [(len(rows) + k, source, f"t{k}", 10 * week - age) for k in range(n)]
    items = spark.createDataFrame(rows, "item_id long, source string, title string, at long")
    got = readers.busy(readers.catalogue(items, items.select("item_id"), 10 * week)).collect()
    assert [(r["source"], r["week"]) for r in got] == [("busy", 300)]


def test_triage_decisions(spark):
    rows = spark.createDataFrame([("GPT news", 0.1, 0.0), ("ad for gpt", 0.9, 0.0), ("x", 0.7, 0.8), ("x", 0.7, 0.0), ("x", 0.5, 0.0), ("x", -0.1, 0.0)], "t string, s double, e double")
    d = triage.decision(F.col("t"), F.col("s"), F.col("e"), 0.62, ["gpt"], ["ad for"])
    got = [tuple(r[0]) for r in rows.select(d).collect()]
    assert got == [("kept", "always_keep: gpt"), ("rejected", "always_drop: ad for"), ("rejected", "closer to excluded (0.800)"),
                   ("kept", "similarity 0.700"), ("rejected", "below threshold (0.500)"), ("rejected", "closer to excluded (0.000)")]


def test_related_topics_compare_own_topics_with_anything(spark):
    rng = np.random.default_rng(1)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    rows = [(f"n{i}", "branch", 1, None, vec()) for i in range(4)] + [("own:x", "own", 1, None, vec())] + [(f"l{i}", "leaf", 2, "n0", vec()) for i in range(3)]
    nodes = spark.createDataFrame(rows, "key string, kind string, depth int, parent string, vector array<double>")
    got = graph.closest(nodes, 3).collect()
    by = {r[0]: r for r in rows}
    for r in got:
        a, b = by[r["key"]], by[r["other"]]
        assert "own" in (a[1], b[1]) or (a[2] == b[2] == 1)
        assert r["lift"] >= 1 - 1e-9


def _stands_out(rows, n):
    """By brute force over one picture: key -> [(other, score, lift)]."""
    out = {}
    for a in rows:
        near = [(b["key"], float(np.dot(a["vector"], b["vector"]))) for b in rows if a["key"] != b["key"] and (
            "own" in (a["kind"], b["kind"]) or (a["depth"] == b["depth"] and (a["depth"] == 1 or a["parent"] != b["parent"])))]
        scores = np.array([s for _, s in near])
        if len(near) < 2 or scores.std() < 1e-6:
            continue
        best = sorted(near, key=lambda x: (-x[1], x[0]))[:n]
        out[a["key"]] = [(k, s, (s - scores.mean()) / scores.std()) for k, s in best if (s - scores.mean()) / scores.std() >= 1 - 1e-9]
    return {k: v for k, v in out.items() if v}


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["other"])):
        out.setdefault(r["key"], []).append((r["other"], r["score"], r["lift"]))
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for k in got:
        assert [x[0] for x in got[k]] == [x[0] for x in want[k]]
        assert np.allclose([x[1:] for x in got[k]], [x[1:] for x in want[k]], rtol=0, atol=1e-9)


NODE_FIELDS = "key string, kind string, depth int, parent string, vector array<double>"


def test_related_topics_of_thousands_of_nodes(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6000, 16)) + 2
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(f"n{i}", "own" if i % 3 == 0 else "leaf", 1 + i % 2, f"p{i % 7}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = _by_key(graph.closest(spark.createDataFrame(rows, NODE_FIELDS), 3).collect())
    # The same numbers from whole matrices; scores are compared to 1e-9.
    scores, number = vectors @ vectors.T, np.arange(6000)
    own, depth, parent = number % 3 == 0, number % 2, number % 7
    allowed = own[:, None] | own[None, :] | ((depth[:, None] == depth[None, :]) & ((depth[:, None] == 0) | (parent[:, None] != parent[None, :])))
    allowed &= ~np.eye(6000, dtype=bool)
    assert len(got) == 6000
    for i in range(6000):
        s = scores[i, allowed[i]]
        lifts = (np.sort(s)[::-1][:3] - s.mean()) / s.std()
        assert np.allclose([x[2] for x in got[f"n{i}"]], lifts[lifts >= 1], rtol=0, atol=1e-9)
        assert all(abs(scores[i, int(k[1:])] - v) < 1e-12 and allowed[i, int(k[1:])] for k, v, _ in got[f"n{i}"])


def test_own_topics_join_the_tree_in_their_readers_picture(spark):
    """Two readers, one of them with most of the topics and split over blocks; equal vectors go to the first key."""
    rng = np.random.default_rng(6)
    vec = lambda: [float(x) for x in rng.normal(size=6)]
    tree = [{"key": f"n{i}", "kind": "branch" if i < 4 else "leaf", "depth": 1 if i < 5 else 2, "parent": None if i < 5 else f"n{i % 2}", "vector": vec()} for i in range(12)]
    told = [vec() for _ in range(9)]
    own = [{"reader": 1 if i < 40 else 2, "key": f"own:{i}", "kind": "own", "depth": 1, "parent": None, "vector": told[i % 9]} for i in range(47)]
    frame = lambda rows, more="": spark.createDataFrame([tuple(r[c.split()[0]] for c in (more + NODE_FIELDS).split(", ")) for r in rows], more + NODE_FIELDS)
    got = graph.closest_with_own(frame(tree), frame(own, "reader long, "), 3, block_rows=8).collect()
    assert {r["reader"] for r in got} == {None, 1, 2}
    for reader in (None, 1, 2):
        mine = [r for r in got if r["reader"] == reader]
        _same(_by_key(mine), _stands_out(tree + [o for o in own if o["reader"] == reader], 3))
    # Without own topics only the tree's picture is left; an empty tree leaves the own topics.
    none = frame(own, "reader long, ").limit(0)
    _same(_by_key(graph.closest_with_own(frame(tree), none, 3, block_rows=8).collect()), _stands_out(tree, 3))
    lone = graph.closest_with_own(frame(tree).limit(0), frame(own, "reader long, ").where("reader = 2"), 3, block_rows=8).collect()
    _same(_by_key(lone), _stands_out([o for o in own if o["reader"] == 2], 3))


def test_nodes_at_one_place_meet_once(spark, monkeypatch):
    """Many nodes at few places: as many rows reach the tiles as there are places, with the results of all nodes."""
    rng = np.random.default_rng(8)
    told = [[float(x) for x in rng.normal(size=6)] for _ in range(7)]
    kind = lambda i: ("own", 1, None) if i % 3 else ("leaf", 1 + i % 2, f"p{i % 2}")
    rows = [{"reader": 1 + i % 2, "key": f"k{i:03d}", **dict(zip(("kind", "depth", "parent"), kind(i))), "vector": told[i % 7]} for i in range(240)]
    # A reader with a key twice, at two places.
    rows += [{"reader": 3, "key": f"k{i % 8}", "kind": "own", "depth": 1, "parent": None, "vector": told[i % 5]} for i in range(11)]
    fields = "reader long, " + NODE_FIELDS
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in fields.split(", ")) for r in rows], fields)
    met, tiles = [], graph._tiles
    monkeypatch.setattr(graph, "_tiles", lambda left, right, *more: met.append(left.count()) or tiles(left, right, *more))
    got = graph.closest(frame, 3, block_rows=4).collect()
    assert sorted(met) == [11, len({(r["reader"], r["kind"], r["depth"], r["parent"], tuple(r["vector"])) for r in rows[:240]})]
    for reader in (1, 2):
        _same(_by_key([r for r in got if r["reader"] == reader]), _stands_out([r for r in rows if r["reader"] == reader], 3))
    again = graph._standing_out(tiles(*[graph._framed(frame).where("reader = 3").withColumns({"scope": F.lit("3"), "deal": F.xxhash64("key")})] * 2, 3, 4), 3).collect()
    assert sorted(map(tuple, again)) == sorted(tuple(r) for r in got if r["reader"] == 3)


def test_unit_makes_its_vector_once(spark):
    """What makes the vector stands in the plan once, not again for every component; a vector without length stays."""
    made = vectors.unit_of_made(F.transform(F.array(F.col("id") * 3, F.col("id") * 4), lambda x: x * 7))
    got = spark.range(3).select(made.alias("v"))
    assert [r["v"] for r in got.collect()] == [[0.0, 0.0], [0.6, 0.8], [0.6, 0.8]]
    assert got._jdf.queryExecution().analyzed().toString().count("cast(7 as bigint)") == 1


def test_own_topics_without_stories_lie_at_their_own_vector(spark):
    topics = spark.createDataFrame([(1, "a", "n:a", None), (1, "b", "n:b", [0.0, 2.0]), (2, "c", "n:c", None)], "reader long, topic_key string, definition string, vector array<double>")
    fitting = spark.createDataFrame([("n:a", 7), ("n:b", 8)], "definition string, story_id long")
    centroids = spark.createDataFrame([(7, [1.0, 0.0])], "story_id long, centroid array<double>")
    got = {r["key"]: r["vector"] for r in graph.own_nodes(topics, fitting, centroids).collect()}
    assert got == {"own:a": [1.0, 0.0], "own:b": [0.0, 1.0]}


def test_names_are_mined_from_words_cut_once(spark, monkeypatch):
    """Three stories of two members each; the texts are cut into words by one job."""
    said = [(i // 2, i, f"T{i}", f"here Ada Lovelace met Babbage and {'babbage ' * (i == 0)}wrote. Then Ada Lovelace left.") for i in range(6)]
    members = spark.createDataFrame([(s, i) for s, i, _, _ in said], "story_id long, item_id long")
    items = spark.createDataFrame([(i, t, x) for _, i, t, x in said], "item_id long, title string, summary string")
    stories = spark.createDataFrame([(s, 86400 * 9) for s in range(3)], "story_id long, last_activity long")
    cut, tokens = spark.sparkContext.accumulator(0), labels._tokens

    @F.udf("string")
    def told(text):
        cut.add(1)
        return text

    monkeypatch.setattr(labels, "_tokens", lambda summary: tokens(told(summary)))
    got = [tuple(r) for r in labels.mine_names(members, items, stories, [["Zed"]], 1).collect()]
    # Ada follows a name in half of its uses, Lovelace in all, Babbage in none.
    assert got == [("Ada Lovelace", 3, ["T0", "T1"]), ("Babbage", 3, ["T0", "T1"]), ("Then Ada", 3, ["T0", "T1"])]
    assert cut.value == 6


def test_ingest_outcomes(spark):
    now = 100 * 86400
    item = "source string, external_id string, kind string, url string, title string, author string, published_s long, summary string, body string, media_url string, metadata string, seq int"
    make = lambda key, title, at, seq=0: ("s", key, "post", "u", title, None, at, None, None, None, None, seq)
    first = spark.createDataFrame([make("a", "A", now), make("b", "B", now), make("old", "O", 1)], item)
    empty = first.limit(0).withColumn("content_hash", F.lit("")).withColumn("triage_state", F.lit("")).withColumn("triage_score", F.lit(0.0)).withColumn("embedded_hash", F.lit(""))
    stored = ingest.upsert(empty, ingest.classify(first, empty, now))
    stored = stored.withColumn("triage_state", F.when(F.col("external_id") == "b", "kept").otherwise(F.col("triage_state")))
    again = spark.createDataFrame([make("a", "A", now), make("b", "draft", now, 0), make("b", "B2", now, 1), make("none", "N", None)], item)
    result = ingest.classify(again, stored, now)
    assert {r["external_id"]: r["outcome"] for r in result.collect()} == {"a": "unchanged", "b": "updated", "none": "inserted"}
    after = {r["external_id"]: (r["title"], r["triage_state"]) for r in ingest.upsert(stored, result).collect()}
    assert after == {"a": ("A", "pending"), "b": ("B2", "kept"), "none": ("N", "pending")}
