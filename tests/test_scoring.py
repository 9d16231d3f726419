"""Scores against many references, and many text searches, beside brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import embed
from storyloom.operators import scoring, search, topics


def frames(spark, rows, references):
    left = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "item_id long, embedding array<float>")
    right = spark.createDataFrame([(f"k{i:05d}", [float(x) for x in v]) for i, v in enumerate(references)], "key string, vector array<double>")
    return left, right


@pytest.mark.parametrize("n", [1, 3, 20, None])
@pytest.mark.parametrize("most", [5000, 10])
def test_best_references_equal_brute_force(spark, n, most):
    """Ties, copies and a row without a vector, by one matrix and by tiles."""
    rng = np.random.default_rng(2)
    rows, references = rng.integers(-2, 3, (30, 8)).astype(np.float32), rng.integers(-2, 3, (60, 8)).astype(float)
    left, right = frames(spark, [*rows, None], references)
    got = {r.item_id: [(b.key, round(b.score, 9)) for b in r.out] for r in scoring.with_best(left, "item_id", "embedding", right, n, "out", most).collect()}
    for i, v in enumerate(rows):
        scores = references @ v.astype(float)
        order = sorted(range(60), key=lambda k: (-scores[k], k))[:n]
        assert got[i] == [(f"k{k:05d}", round(float(scores[k]), 9)) for k in order]
    assert got[30] == []
    assert all(r.out == [] for r in scoring.with_best(left, "item_id", "embedding", right.limit(0), n, "out", most).collect())


def test_five_thousand_references_in_many_tiles(spark):
    rng = np.random.default_rng(3)
    rows, references = rng.normal(size=(40, 16)).astype(np.float32), rng.normal(size=(5000, 16))
    left, right = frames(spark, rows, references)
    whole = rows.astype(float) @ references.T
    for found in (
        scoring.with_best(left, "item_id", "embedding", right, 5, "best").select("item_id", "best"),
        scoring.best_in_tiles(left.select(F.col("item_id").alias("_row"), F.col("embedding").alias("_vector")), right, 5, block_rows=100).withColumnRenamed("_row", "item_id"),
    ):
        for r in found.collect():
            order = np.argsort(-whole[r.item_id], kind="stable")[:5]
            assert [b.key for b in r.best] == [f"k{k:05d}" for k in order]
            assert np.allclose([b.score for b in r.best], whole[r.item_id][order])


def test_filing_by_more_leaves_than_go_to_every_task(spark):
    rng = np.random.default_rng(4)
    leaves = rng.normal(size=(5000, 8))
    leaves /= np.linalg.norm(leaves, axis=1, keepdims=True)
    stories = spark.createDataFrame([(i, [float(x) for x in leaves[37 * i]]) for i in range(20)], "story_id long, centroid array<double>")
    _, references = frames(spark, [], leaves)
    spine = spark.createDataFrame([(f"k{i:05d}", f"shelf{i}") for i in range(5000)], "slug string, parent string")
    got = topics.assign(stories, None, references, None, spine, [], 0.5, 0.5, 0.0)
    assert {r.story_id: (r.home, r.how) for r in got.collect()} == {i: (f"k{37 * i:05d}", "leaf") for i in range(20)}


ODD_KEYS = ["", "%", "_", "a%c", "a_c", "\\%", "x\\_y", "ÄÖ", "100%", "Abc", "abc", "b", "İ", "zz_", "%c"]
ODD_TEXTS = ["abc", "aXc", "ABBC", "äö", "50\\% off", "x_y", "100 per", "", None, "a\nc", "İstanbul", "zz", "b" * 50]


@pytest.mark.parametrize("most", [100, 1])
def test_searches_equal_ilike(spark, most):
    keys = spark.createDataFrame([(k,) for k in [*ODD_KEYS, None, "b"]], "key string")
    texts = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, text string")
    got = {(r.id, r.key) for r in search.matches(keys, texts, most, 4, 3).collect()}
    met = texts.alias("t").join(keys.alias("k"), F.ilike(F.col("text"), F.concat(F.lit("%"), F.col("key"), F.lit("%"))))
    assert got == {(r.id, r.key) for r in met.select("id", "key").distinct().collect()}
    assert search.matches(keys.limit(0), texts, most).count() == 0 and search.matches(keys, texts.limit(0), most).count() == 0


def test_twenty_thousand_searches(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    keys = sorted({word() for _ in range(26000)})[:20000]
    titles = [" ".join(word().title() for _ in range(8)) for _ in range(300)]
    stories = spark.createDataFrame([(i,) for i in range(300)], "story_id long")
    members = spark.createDataFrame([(i, i) for i in range(300)], "story_id long, item_id long")
    items = spark.createDataFrame([(i, t, i // 2) for i, t in enumerate(titles)], "item_id long, title string, at long")
    asked = spark.createDataFrame([(k,) for k in [*keys, "17", "9999"]], "key string")
    got = {r.key: r.story_id for r in topics.find_story(asked, stories, members, items).collect()}
    want = {k: max(i for i, t in enumerate(titles) if k in t.lower()) for k in keys if any(k in t.lower() for t in titles)}
    assert got == {**want, "17": 17}


def test_vectors_of_another_model_are_refused(spark):
    """Also those of the same dimension; with one model only what is missing or stale is embedded."""
    item = "item_id long, content_hash string, kind string, title string, summary string, body string, metadata string"
    items = spark.createDataFrame([(i, f"h{i}", "post", f"word{i}", None, None, None) for i in range(4)], item)
    made = "item_id long, content_hash string, model string, embedding array<float>"
    vectors = spark.createDataFrame([(0, "h0", "one", [1.0, 0.0]), (1, "old", "one", [1.0, 0.0]), (9, "h9", "one", [1.0, 0.0])], made)
    asked = embed.hashed_terms(2)
    got = {r["item_id"]: (r["content_hash"], r["model"], sum(r["embedding"])) for r in embed.embed_pending(items, vectors, "one", asked).collect()}
    assert got == {0: ("h0", "one", 1.0), 9: ("h9", "one", 1.0), **{i: (f"h{i}", "one", 1.0) for i in (1, 2, 3)}}
    for name in ("two", None):
        mixed = vectors.unionByName(spark.createDataFrame([(5, "h5", name, [0.0, 1.0])], made))
        with pytest.raises(ValueError, match="not 'one'"):
            embed.embed_pending(items, mixed, "one", asked)
    assert embed.embed_pending(items, vectors.limit(0), "one", asked).count() == 4
