"""The published lines, with one story much larger than the others."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import bundle
from storyloom.sources import bundles


def test_a_large_story_is_written_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(bundle, "ITEMS_PER_LINE", 10)
    items = spark.createDataFrame([(i, "post", f"t{i}", f"u{i}", "s", i) for i in range(100)], "item_id long, kind string, title string, url string, source string, published_s long")
    members = spark.createDataFrame([(0 if i < 95 else i, i, "seed") for i in range(100)], "story_id long, item_id long, role string")
    rows = members.select("story_id", F.lit(0).cast("long").alias("newest")).distinct()
    lines = [json.loads(r["line"]) for r in bundle.story_items(rows, members, items).collect()]
    held = [(line["story_id"], item["title"]) for line in lines for item in line["items"]]
    assert len(held) == len(set(held)) == 100
    assert len([line for line in lines if line["story_id"] == 0]) > 5
    assert max(len(line["items"]) for line in lines) < 40
    assert all([i["published_at"] for i in line["items"]] == sorted(i["published_at"] for i in line["items"]) for line in lines)


LINES = "section string, story_id long, chunk long, line string"
ODD = [("story", 3, 0, '{"title":"a\\nb ,\\"body\\": é \\u2028"}'), ("story", 2, 0, '{"title":null}'), ("items", 2, 1, '{"items":[]}'), ("spine", None, 0, '{"slug":"x"}')]


def as_rows(df):
    return [tuple(r) for r in df.select("section", "story_id", "chunk", "line").collect()]


def test_a_bundle_is_read_as_it_was_written(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    bundles.write(spark.createDataFrame(ODD, LINES).coalesce(1), folder, "2024-03-01T00:00:00Z")
    assert as_rows(bundles.read(spark, folder)) == ODD
    manifest = json.loads((tmp_path / "b" / "manifest.json").read_text())
    assert manifest["generated_at"] == "2024-03-01T00:00:00Z"
    assert manifest["sections"] == {"items": 1, "spine": 1, "story": 2} and manifest["rows"] == 4
    published = [json.loads(line) for part in manifest["parts"] for line in (tmp_path / "b" / part["file"]).read_text().split("\n")[:-1]]
    assert published[1] == {"section": "story", "story_id": 2, "chunk": 0, "body": {"title": None}}


def test_parts_keep_the_order_of_the_frame(spark, tmp_path):
    folder = str(tmp_path / "b")
    rows = spark.range(5000).select(F.lit("story").alias("section"), F.col("id").alias("story_id"), F.lit(0).cast("long").alias("chunk"), F.lit("{}").alias("line"))
    bundles.write(rows.repartitionByRange(4, F.desc("story_id")).sortWithinPartitions(F.desc("story_id")), folder)
    manifest = bundles.read_manifest(folder)
    held = [json.loads(line)["story_id"] for part in manifest["parts"] for line in (tmp_path / "b" / part["file"]).read_text().splitlines()]
    assert held == list(range(4999, -1, -1)) and len(manifest["parts"]) > 1


def test_a_failed_write_leaves_the_bundle_before_it(spark, tmp_path):
    folder = str(tmp_path / "b")
    failing = spark.range(40, numPartitions=4).select(
        F.lit("story").alias("section"), F.col("id").alias("story_id"), F.lit(0).cast("long").alias("chunk"),
        F.when(F.col("id") == 35, F.raise_error(F.lit("no such line"))).otherwise(F.lit("{}")).alias("line"))
    with pytest.raises(Exception):
        bundles.write(failing, folder)
    assert bundles.read_manifest(folder) is None
    with pytest.raises(Exception, match="no bundle"):
        bundles.read(spark, folder).collect()
    bundles.write(spark.createDataFrame(ODD, LINES), folder)
    with pytest.raises(Exception):
        bundles.write(failing, folder)
    assert sorted(map(repr, as_rows(bundles.read(spark, folder)))) == sorted(map(repr, ODD))


def test_only_named_parts_are_read_and_a_later_bundle_replaces_them(spark, tmp_path):
    folder = str(tmp_path / "b")
    bundles.write(spark.createDataFrame(ODD, LINES), folder)
    first = [p["file"] for p in bundles.read_manifest(folder)["parts"]]
    (tmp_path / "b" / "part-000000-lost-1.jsonl").write_text('{"section":"story","story_id":9,"chunk":0,"body":{}}\n')
    bundles.write(spark.createDataFrame(ODD[:1], LINES), folder)
    assert as_rows(bundles.read(spark, folder)) == ODD[:1]
    assert not any((tmp_path / "b" / name).exists() for name in first)
    with pytest.raises(Exception, match="holds a bundle"):
        spark.createDataFrame(ODD, LINES).write.format("bundle").mode("append").save(folder)


def test_an_empty_and_a_damaged_bundle(spark, tmp_path):
    folder = str(tmp_path / "b")
    bundles.write(spark.createDataFrame([], LINES), folder)
    assert as_rows(bundles.read(spark, folder)) == [] and bundles.read_manifest(folder)["rows"] == 0
    bundles.write(spark.createDataFrame(ODD, LINES).coalesce(1), folder)
    part = tmp_path / "b" / bundles.read_manifest(folder)["parts"][0]["file"]
    part.write_text("".join(part.read_text().splitlines(keepends=True)[:-1]))
    with pytest.raises(Exception, match="damaged"):
        bundles.read(spark, folder).collect()


def test_sections_and_their_fields(spark):
    topics = spark.createDataFrame([("safety", "Safety & security", None, "d"), ("misuse", "Misuse", "safety", "d")], "slug string, name string, parent string, description string")
    named = {r.slug: r.asDict() for r in bundle.fields(bundle.spine(topics)).collect()}
    assert (named["safety"]["description"], named["misuse"]["description"], named["misuse"]["parent_name"]) == ("d", None, "Safety & security")
    assert bundle.spine(topics.limit(0)).count() == 0
    items = spark.createDataFrame([("kept", 5), ("kept", 7), ("pending", 3)], "triage_state string, at long")
    stories = spark.range(2).select(F.col("id").alias("story_id"))
    sources = spark.createDataFrame([("a", True, "HTTP 404"), ("b", False, "HTTP 500"), ("c", True, None)], "name string, enabled boolean, last_error string")
    got = {r.section: r for r in bundle.fields(bundle.status(items, stories, sources)).collect()}
    assert (got["status"].stories, got["status"].kept, got["status"].rejected, got["status"].pending, got["status"].newest_item) == (2, 2, 0, 1, "1970-01-01T00:00:07Z")
    assert (got["broken"].name, got["broken"].error) == ("a", "HTTP 404")
    none = {r.section: r for r in bundle.fields(bundle.status(items.limit(0), stories.limit(0), sources.limit(0))).collect()}
    assert list(none) == ["status"] and (none["status"].stories, none["status"].kept, none["status"].newest_item) == (0, 0, None)


def test_a_story_carries_its_whole_summary_all_labels_and_a_vector_that_points_the_same_way(spark):
    rng = np.random.default_rng(3)
    vector = rng.normal(size=64)
    vector /= np.linalg.norm(vector)
    rows = spark.createDataFrame([(1, 100, 0.123456), (2, 90, 0.5)], "story_id long, newest long, score double")
    cards = spark.createDataFrame([(i, "t", "s" * 5000, "u", "post", "x", ["x"], 50, None, 1) for i in (1, 2)],
                                  "story_id long, title string, summary string, url string, kind string, source string, sources array<string>, published_s long, media_url string, item_count long")
    labels = spark.createDataFrame([(1, "b", "B", "a", "A", ["a"]), (1, "c", "C", None, None, [])], "story_id long, slug string, name string, parent string, parent_name string, path array<string>")
    entities = spark.createDataFrame([(1, "tool", "Z"), (1, "org", "A"), (1, "org", "A")], "story_id long, kind string, name string")
    loud = spark.createDataFrame([(1, 7, None)], "story_id long, points long, comments long")
    centroids = spark.createDataFrame([(1, vector.tolist())], "story_id long, centroid array<double>")
    got = {r.story_id: r for r in bundle.fields(bundle.stories(rows, cards, labels, entities, centroids, loud)).collect()}
    assert got[1].summary == "s" * 5000 and got[1].score == 0.1235
    assert [t.slug for t in got[1].topics] == ["b", "c"] and [(e.kind, e.name) for e in got[1].entities] == [("org", "A"), ("tool", "Z")]
    assert (got[1].engagement.points, got[1].engagement.comments) == (7, None)
    back = np.frombuffer(base64.b64decode(got[1].centroid), np.int8).astype(float)
    assert np.abs(back - 127 * vector).max() <= 0.5  # no component is off by more than rounding
    assert (got[2].topics, got[2].entities, got[2].centroid, got[2].engagement) == ([], [], None, None)
    short = bundle.fields(bundle.stories(rows, cards, labels, entities, centroids, loud, summary_limit=40)).first()
    assert short.summary == "s" * 40 + "…"
