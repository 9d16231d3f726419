"""The distributed forms against plain sequential ones on random input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import calibrate, cluster, feed, readers, similarity, subjects

DAY = 86400


def random_items(rng, n, dim=6, hot=False):
    centres = rng.normal(size=(5, dim))
    vectors = centres[rng.integers(0, 5, n)] + rng.normal(scale=0.35, size=(n, dim))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if hot:  # a third of all rows are copies in one week
        vectors[: n // 3] = vectors[0]
    at = rng.integers(0, 60 * DAY, n)
    if hot:
        at[: n // 3] = rng.integers(20 * DAY, 27 * DAY, n // 3)
    return vectors.astype(np.float32), at


def frame(spark, vectors, at, batch):
    rows = [(int(i), int(b), int(t), [float(x) for x in v]) for i, (v, t, b) in enumerate(zip(vectors, at, batch))]
    return spark.createDataFrame(rows, "item_id long, batch int, at long, embedding array<float>")


def sequential(vectors, at, batch, keys, merge, low, window):
    """Items in order, each looking only at those before it."""
    v = vectors.astype(np.float64)
    order = sorted(range(len(at)), key=lambda i: (batch[i], at[i], i))
    story, seen = {}, []
    for i in order:
        if batch[i] == 0:
            story[i] = i
        else:
            held = [j for j in seen if keys.get(i) is not None and keys.get(j) == keys.get(i)]
            if held:
                story[i] = story[held[0]]
            else:
                best, score = None, -2.0
                for j in seen:
                    s = round(float(v[i] @ v[j]), 9)
                    if abs(at[i] - at[j]) <= window and s > score:
                        best, score = j, s
                story[i] = story[best] if best is not None and score >= merge else i
        seen.append(i)
    return story


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_clustering_equals_the_sequential_form(spark, seed, hot):
    rng = np.random.default_rng(seed)
    vectors, at = random_items(rng, 150, hot=hot)
    batch = (rng.random(150) > 0.2).astype(int)
    keys = {i: f"k{rng.integers(0, 40)}" for i in range(150) if rng.random() < 0.4}
    counts = {k: list(keys.values()).count(k) for k in set(keys.values())}
    keys = {i: k for i, k in keys.items() if counts[k] <= 8}
    members = frame(spark, vectors, at, batch)
    ids = spark.createDataFrame([(i, "arxiv", k) for i, k in keys.items()], "item_id long, type string, value string")
    stored = members.where("batch = 0").select("item_id", F.col("item_id").alias("story_id"))
    got = cluster.assign(members, ids, stored, 0.9, 0.8, 14)
    expected = sequential(vectors, at, batch, keys, 0.9, 0.8, 14 * DAY)
    assert {r["item_id"]: r["story_id"] for r in got.collect()} == {i: s for i, s in expected.items() if batch[i] == 1}


@pytest.mark.parametrize("hot,floor,block", [(False, 0.9, 16), (True, 0.8, 8), (False, -0.5, 1000)])
def test_best_earlier_equals_brute_force(spark, hot, floor, block):
    vectors, at = random_items(np.random.default_rng(5), 200, hot=hot)
    rows = frame(spark, vectors, at, np.ones(200, dtype=int))
    got = {r["item_id"]: (r["match"], round(r["score"], 6)) for r in similarity.best_earlier(rows, rows, 7 * DAY, floor, block).collect()}
    v = vectors.astype(np.float64)
    want = {}
    for i in range(200):
        earlier = [j for j in range(200) if (at[j], j) < (at[i], i) and abs(at[i] - at[j]) <= 7 * DAY]
        if earlier:
            best = min(earlier, key=lambda j: (-round(float(v[i] @ v[j]), 9), at[j], j))
            if v[i] @ v[best] >= floor:
                want[i] = (best, round(float(v[i] @ v[best]), 6))
    assert got == want


def test_close_pair_bins_equal_brute_force(spark):
    vectors, at = random_items(np.random.default_rng(7), 120, hot=True)
    rows = frame(spark, vectors, at, np.ones(120, dtype=int)).select("item_id", "at", "embedding")
    got = {r["bin"]: r["pairs"] for r in calibrate.close_pair_bins(rows, 7, block_rows=16).collect()}
    v, want = vectors.astype(np.float64), {}
    for a in range(120):
        for b in range(a + 1, 120):
            if abs(at[a] - at[b]) <= 7 * DAY:
                k = int(np.floor(np.round(v[a] @ v[b] * calibrate.BINS, 6)))
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_pointer_jumping_settles_a_long_chain(spark):
    rows = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(100)], "item_id long, parent long")
    assert {r["root"] for r in cluster.roots(rows).collect()} == {0}


def test_tiles_and_matrix_agree(spark):
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 5)))
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(unit(30))], "key string, vector array<double>")
    stories = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(90))], "story_id long, centroid array<double>")
    one = {(r["key"], r["story_id"]) for r in readers._close(queries, stories, 0.5).collect()}
    two = {(r["key"], r["story_id"]) for r in readers.close_in_tiles(queries, stories, 0.5, block_rows=7).collect()}
    assert one == two and one


def test_diversify_equals_greedy(spark):
    rng = np.random.default_rng(11)
    cards = [(i, f"s{rng.integers(0, 4)}", f"k{rng.integers(0, 3)}", float(rng.random())) for i in range(60)]
    rows = spark.createDataFrame(cards, "story_id long, source string, kind string, score double")
    got = [r["story_id"] for r in feed.diversify(rows, 12).orderBy("place").collect()]
    left, want, sources, kinds = list(cards), [], {}, {}
    while len(want) < 12:
        best = max(left, key=lambda c: (c[3] * 0.55 ** sources.get(c[1], 0) * 0.8 ** kinds.get(c[2], 0), -c[0]))
        left.remove(best)
        want.append(best[0])
        sources[best[1]] = sources.get(best[1], 0) + 1
        kinds[best[2]] = kinds.get(best[2], 0) + 1
    assert got == want


def test_roles(spark):
    rows = spark.createDataFrame([("article", True), ("article", False), ("model", False), ("model", True), ("paper", False)], "kind string, opens boolean")
    assert [r[0] for r in rows.select(cluster.role(F.col("kind"), F.col("opens"))).collect()] == ["seed", "coverage", "code", "seed", "paper"]


def leader_pass(vectors, order, floor):
    heads, sums, members = [], [], []
    for i in order:
        best, score = -1, floor
        for g, head in enumerate(heads):
            if (s := float(head @ vectors[i])) >= score:
                best, score = g, s
        if best < 0:
            members.append([i])
            sums.append(vectors[i].copy())
            heads.append(vectors[i].copy())
        else:
            members[best].append(i)
            sums[best] = sums[best] + vectors[i]
            heads[best] = sums[best] / np.linalg.norm(sums[best])
    return {m: group[0] for group in members for m in group}


def test_subject_groups_equal_the_leader_pass(spark):
    vectors, at = random_items(np.random.default_rng(9), 120)
    v = vectors.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, int(at[i]), v[i].tolist()) for i in range(120)], "story_id long, newest long, centroid array<double>")
    want = leader_pass(v, sorted(range(120), key=lambda i: (-at[i], i)), 0.8)
    got = {r["story_id"]: r["leader"] for r in subjects.groups(rows, 0.8).collect()}
    assert got == want
    # In chunks every story still has one group, and far fewer groups than stories are left.
    split = {r["story_id"]: r["leader"] for r in subjects.groups(rows, 0.8, chunk=30).collect()}
    assert set(split) == set(range(120)) and len(set(split.values())) <= 2 * len(set(want.values()))


def test_subject_groups_are_the_leader_pass_at_any_size(spark):
    rng = np.random.default_rng(4)
    n = 2200
    v = rng.normal(size=(60, 24))[rng.integers(0, 60, n)] + rng.normal(size=(n, 24)) * 0.4
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = rng.integers(0, 500, n)
    rows = spark.createDataFrame([(i, int(at[i]), v[i].tolist()) for i in range(n)], "story_id long, newest long, centroid array<double>")
    want = leader_pass(v, sorted(range(n), key=lambda i: (-at[i], i)), 0.8)
    for chunk in (subjects.CHUNK, 30):
        assert {r["story_id"]: r["leader"] for r in subjects.groups(rows, 0.8, chunk).collect()} == want


def grouped_vectors(rng, groups, each, dim=64, spread=0.03):
    centres = similarity.unit_rows(rng.normal(size=(groups, dim)))
    return similarity.unit_rows(np.repeat(centres, each, 0) + rng.normal(scale=spread, size=(groups * each, dim)))


def test_leading_coordinates_skip_most_pairs_and_lose_none():
    rng = np.random.default_rng(8)
    v = grouped_vectors(rng, 40, 30)
    axes = similarity.leading_axes(v)
    rows, _ = similarity.surviving(v, v, axes, 0.86)
    assert len(rows) < 0.5 * len(v) ** 2
    exact = v @ v.T
    got = similarity.candidate_pairs(v, v, axes, 0.86)
    assert set(zip(got[0].tolist(), got[1].tolist())) == set(zip(*(x.tolist() for x in np.nonzero(exact >= 0.86))))
    assert np.allclose(got[2], exact[got[0], got[1]])


def test_centres_leave_small_radii_or_one_for_each_block():
    v = grouped_vectors(np.random.default_rng(9), 30, 40)
    centres = similarity.farthest_first(v, 1000, 0.9)
    assert 30 <= len(centres) < 60 and np.arccos(np.clip(v @ centres.T, -1, 1)).min(1).max() <= 0.9
    assert len(similarity.farthest_first(v, 7, 0.0)) == 7
    assert len(similarity.farthest_first(np.repeat(v[:1], 9, 0), 5, 0.01)) == 1


def test_many_cells_and_copies_equal_brute_force(spark):
    """Groups, copies at the same and at other times, stored and new items, at several cells a bucket."""
    rng = np.random.default_rng(10)
    v = grouped_vectors(rng, 12, 25, dim=16, spread=0.1).astype(np.float32)
    v[100:220] = v[100]
    at = rng.integers(0, 40 * DAY, len(v))
    at[100:160] = rng.integers(10, 13, 60) * DAY
    batch = (rng.random(len(v)) > 0.3).astype(int)
    members = frame(spark, v, at, batch)
    new = members.where("batch = 1")
    got = {r["item_id"]: (r["match"], round(r["score"], 6)) for r in similarity.best_earlier(new, members, 7 * DAY, 0.7, 20).collect()}
    w, want = v.astype(np.float64), {}
    for i in np.flatnonzero(batch == 1).tolist():
        earlier = [j for j in range(len(v)) if (batch[j], at[j], j) < (batch[i], at[i], i) and abs(at[i] - at[j]) <= 7 * DAY]
        best = min(earlier, key=lambda j: (-round(float(w[i] @ w[j]), 9), batch[j], at[j], j), default=None)
        if best is not None and w[i] @ w[best] >= 0.7:
            want[i] = (best, round(float(w[i] @ w[best]), 6))
    assert got == want


def test_a_vector_is_compared_once_however_often_it_occurs():
    """Copies are members of one candidate; the one that counts is found by its time."""
    at = np.array([0, 5, 9, 2, 7])
    members = {"group": np.array([0, 0, 0, 1, 1]), "batch": np.array([1, 1, 1, 0, 1]), "at": at, "item_id": np.array([10, 11, 12, 20, 21])}
    find = lambda group, when, batch, who: similarity.earliest_members(*(np.array([x]) for x in (group, when, batch, who)), members, 4)[0]
    assert find(0, 9, 1, 50) == 1 and find(0, 4, 1, 50) == 0 and find(0, 5, 1, 11) == -1 and find(0, 5, 1, 12) == 1 and find(0, 0, 1, 9) == -1
    assert find(1, 0, 1, 1) == 3 and find(1, 8, 1, 50) == 4 and find(1, 7, 1, 21) == -1 and find(1, 0, 0, 1) == -1


def test_names_are_found_by_their_rarest_word(spark):
    """Names of one to three words over few words, some of them in most stories and dealt to several keys."""
    rng = np.random.default_rng(12)
    words = np.array(["alpha", "betas", "gamma", "delta", "box", "boxes", "zeta"])
    texts = [(int(s), " ".join(rng.choice(words, rng.integers(1, 5)))) for s in rng.integers(0, 60, 150)]
    names = [" ".join(rng.choice(["alpha", "beta", "gamma", "box", "zeta", "the", "nowhere"], rng.integers(1, 4))) for _ in range(40)] + ["the", ""]
    small = ("the",)
    held = {}
    for s, t in texts:
        held.setdefault(s, set()).update(t.split())
    has = lambda story, w: any(form in held[story] for form in (w, w + "s", w + "es"))
    want = {(n, s) for n in names for s in held if (asked := set(n.split()) - set(small)) and all(has(s, w) for w in asked)}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for postings in (50_000, 4):
        got = readers.named_in(rows, spark.createDataFrame(texts, "story_id long, text string"), postings).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_topics_of_several_examples_and_muted_words(spark):
    centroids = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7]), (4, [-1.0, 0.0])], "story_id long, centroid array<double>")
    topics = spark.createDataFrame([("a", "t1", None, "x"), ("b", "t2", None, "x"), ("c", "t3", "here", "x"), ("d", "t4", None, "red box")], "reader string, topic_key string, spine string, name string")
    examples = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 2), ("t2", 1)], "topic_key string, example long")
    places = spark.createDataFrame([(4, "here")], "story_id long, place string")
    cards = spark.createDataFrame([(1, "100% sure", "s"), (2, "1000 sure", None), (3, "Boxes", "of red"), (4, "under_score", None)], "story_id long, title string, summary string")
    texts = cards.selectExpr("story_id", "concat_ws(' ', title, summary) AS text")
    sources = spark.createDataFrame([(t, "s") for t in ("t1", "t2", "t3", "t4")], "topic_key string, source string")
    offered = spark.createDataFrame([(i, "s") for i in (1, 2, 3, 4)], "story_id long, source string")
    muted = spark.createDataFrame([("t1", "0%"), ("t1", "zzz"), ("t2", "BOX"), ("t3", "r_s"), ("t4", "")], "topic_key string, word string")
    got = readers.in_topic(topics, examples, places, texts, centroids, sources, offered, cards, muted, 0.9).collect()
    # The mean of 1 and 2 is 3's direction; either example belongs in any case.
    assert {(r.reader, r.story_id) for r in got} == {("a", 2), ("a", 3), ("b", 1), ("b", 2), ("d", 3)}


@pytest.mark.parametrize("n", [1, 2, 7, 4000])
def test_quantiles_by_rank(spark, n):
    """Interpolated as over the whole sorted list, a third of the scores being equal; nulls do not count."""
    rng = np.random.default_rng(n)
    scores = rng.normal(size=n)
    scores[: n // 3] = 0.25
    rows = [(i, float(x)) for i, x in enumerate(scores)] + [(n, None)]
    got = calibrate.summary(spark.createDataFrame(rows, "a long, score double")).first()
    assert got["n"] == n and got["min"] == scores.min() and got["max"] == scores.max()
    assert np.allclose([got["p5"], got["median"], got["p95"]], np.quantile(scores, [0.05, 0.5, 0.95]), rtol=0, atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert tuple(calibrate.summary(spark.createDataFrame([], "a long, score double")).first()) == (0, None, None, None, None, None)


def test_close_pairs_of_a_floor(spark):
    """Every pair within a week from the floor on, whichever blocks its items lie in, and as many as the bins count."""
    rng = np.random.default_rng(12)
    v, at = random_items(rng, 150, hot=True)
    rows = frame(spark, v, at, np.zeros(150, int)).repartition(5)
    got = {(r["a"], r["b"]): r["score"] for r in calibrate.close_pairs(rows, 0.8, 7, block_rows=16).collect()}
    wide = v.astype(np.float64)
    want = {(a, b): float(wide[a] @ wide[b]) for a in range(150) for b in range(a + 1, 150) if abs(int(at[a]) - int(at[b])) <= 7 * DAY and wide[a] @ wide[b] >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    counted = sum(r["pairs"] for r in calibrate.close_pair_bins(rows, 7, block_rows=16).collect() if r["bin"] >= 0.8 * calibrate.BINS)
    assert counted == len(want)


def test_offers_against_every_topic_and_story(spark):
    """Random topics, listed twice with other definitions, too; against pair by pair, in lists of a few rows."""
    rng = np.random.default_rng(5)
    definitions, sources = ["a", "b", "c"], ["s", "t", "u"]
    some = lambda of, n: sorted(set(rng.choice(of, n).tolist()))
    topics = [(int(k) % 4, f"t{k}", some(definitions, 2), some(sources, 2)) for k in range(30)]
    stories = {i: (some(sources, 1), bool(i % 3), None if i % 7 == 0 else int(rng.integers(0, 1000))) for i in range(60)}
    fitting = sorted({(str(rng.choice(definitions)), int(i)) for i in rng.integers(0, 60, 120)})
    asking = spark.createDataFrame(topics, "reader long, topic_key string, says array<string>, sources array<string>")
    fits = spark.createDataFrame([(d, i, *stories[i]) for d, i in fitting], "definition string, story_id long, by array<string>, fresh boolean, published_s long")
    want = {(r, k, i) for r, k, says, takes in topics for d, i in fitting if d in says and set(takes) & set(stories[i][0])}
    seen = [(int(r), int(i), "seen") for r, i in rng.integers(0, [4, 60], (150, 2))]
    marks, read = spark.createDataFrame(seen, "reader long, story_id long, action string"), {(r, i) for r, i, _ in seen}
    old = readers.LIST_ROWS
    for rows in (old, 3):
        readers.LIST_ROWS = rows
        try:
            takers, offered = readers.offers(asking, fits, ("sources",), ("by",), lambda s: readers._shared(s["by"], F.col("sources")))
            each = readers.taken(takers, offered, task_rows=50)
            got = [tuple(r) for r in each.select("reader", "topic_key", "story_id").collect()]
            assert set(got) == want and len(got) == len(want)
            new = {(r, k, i) for r, k, i in want if stories[i][1] and (r, i) not in read}
            flagged = [tuple(r) for r in readers.is_new(each, marks).select("reader", "topic_key", "story_id", "is_new").collect()]
            assert sorted(flagged) == sorted((*w, w in new) for w in want)
            counts = {r.topic_key: (r.new, r.stories) for r in readers.new_counts(takers, offered, marks).collect()}
            assert counts == {k: (sum(n[1] == k for n in new), sum(w[1] == k for w in want)) for k in {w[1] for w in want}}
            feed = [tuple(r) for r in readers.read_order(takers, offered).collect()]
            assert len(feed) == len(set(feed)) and set(feed) == {(r, i, stories[i][2]) for r, _, i in want}
            when = [(r, p is None, -(p or 0)) for r, _, p in feed]
            assert when == sorted(when)
        finally:
            readers.LIST_ROWS = old


def test_topics_of_one_offer_meet_its_stories_once(spark):
    """What is moved are lists: as many rows as offers have, not as topics times stories."""
    asking = spark.createDataFrame([(k, f"t{k}", ["a"]) for k in range(300)], "reader long, topic_key string, says array<string>")
    takers, offered = readers.offers(asking, spark.range(200).selectExpr("'a' AS definition", "id AS story_id"))
    assert offered.count() == 1 and readers.taken(takers, offered).count() == 60_000


def test_only_many_marks_move_the_rows_of_a_topic(spark, monkeypatch):
    """New and read are told where a topic's rows are made; rows of topics with many marks alone are joined, with the same results."""
    rng = random.Random(6)
    topics = [(r, f"t{r}-{k}", ["a"] if (r + k) % 3 else ["b"]) for r in range(12) for k in range(2)] + [(None, "t", ["a"])]
    asking = spark.createDataFrame(topics, "reader long, topic_key string, says array<string>")
    fits = spark.createDataFrame([(d, i, i % 3 == 0) for d in "ab" for i in range(60)], "definition string, story_id long, fresh boolean")
    rows = [(r, i) for r in range(12) for i in rng.sample(range(60), 30 if r == 5 else r % 4)] * 2 + [(None, 0), (3, None)]
    seen = spark.createDataFrame(rows, "reader long, story_id long")
    takers, offered = readers.offers(asking, fits)
    want = sorted((str(r), t, i, i % 3 == 0 and (r is None or (r, i) not in rows)) for r, t, _ in topics for i in range(60))
    met, joined = [], readers.is_new
    monkeypatch.setattr(readers, "is_new", lambda each, marks: met.append(each.count()) or joined(each, marks))
    for in_place, moved in ((64, 0), (4, 120)):
        got = readers.new_rows(takers, offered, seen, in_place).select("reader", "topic_key", "story_id", "is_new").collect()
        assert sorted((str(r.reader), r.topic_key, r.story_id, r.is_new) for r in got) == want
        assert met.pop() == moved
