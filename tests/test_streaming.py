"""Streams in several micro-batches give what one batch would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.model import relation
from storyloom.operators import cluster, readers
from storyloom.session import checkpoint_folder
from storyloom.streaming import jobs as J

DAY = 86400


def in_files(spark, rows, schema, folder, files):
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size:(n + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_read_marks_do_not_depend_on_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 4)), int(rng.integers(0, 6)), str(rng.choice(["shown", "passed", "end"], p=[0.6, 0.3, 0.1])), i) for i in range(200)]
    schema = "reader long, story_id long, action string, seq long"
    stream = in_files(spark, rows, schema, str(tmp_path / "in"), 3)
    J.read_mark_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.schema("reader long, story_id long").parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in readers.read_marks(spark.createDataFrame(rows, schema)).collect())
    assert got == want and len(got) == len(set(got))


def test_cluster_stream_keeps_stories_across_batches(spark, tmp_path):
    axis = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    rows = [(1, 0, axis(0)), (2, DAY, axis(1)), (3, 2 * DAY, axis(0)), (4, 30 * DAY, axis(0)), (5, 31 * DAY, axis(2)), (6, 40 * DAY, axis(3))]
    schema = "item_id long, at long, embedding array<float>"
    keys = spark.createDataFrame([(2, "arxiv", "k"), (6, "arxiv", "k")], "item_id long, type string, value string")
    stream = in_files(spark, rows, schema, str(tmp_path / "in"), 3)
    store = J.Versions(spark, str(tmp_path / "out"))
    J.cluster_stream(stream, keys, store, str(tmp_path / "cp"), 0.9, 0.8, 14)
    got = {r["item_id"]: (r["story_id"], r["how"]) for r in store.before().collect()}
    # 4 comes too late for 1 and 3; 6 joins 2 by identifier, whatever the time.
    assert got == {1: (1, "new"), 2: (2, "new"), 3: (1, "similarity"), 4: (4, "new"), 5: (5, "new"), 6: (2, "identifier")}


def test_a_replayed_batch_replaces_its_first_try(spark, tmp_path):
    store = J.Versions(spark, str(tmp_path / "v"))
    store.write(spark.range(3), 0)
    store.write(spark.range(5), 1)
    assert store.before(1).count() == 3 and store.before().count() == 5
    store.write(spark.range(4), 1)
    assert store.before().count() == 4


def test_a_table_of_one_file_and_one_of_many_are_streamed_alike(spark, tmp_path):
    rows = spark.range(12).repartition(3)
    rows.write.parquet(str(tmp_path / "many.parquet"))
    spark.range(5).toPandas().to_parquet(tmp_path / "one.parquet")
    for name, want in (("many", 12), ("one", 5)):
        stream = J.stream_of(spark, str(tmp_path), name, 1)
        for _ in range(2):
            J.drain(stream, str(tmp_path / f"cp-{name}"), str(tmp_path / f"out-{name}"))
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / f"out-{name}")).collect()) == list(range(want))


def test_the_checkpoint_folder_is_set(spark):
    assert checkpoint_folder(spark) and spark.sparkContext.getCheckpointDir()


def test_relations_have_one_row_per_key(spark):
    items = relation(spark, "/root/testdata/sf0.001", "items")
    assert items.count() == items.select("item_id").distinct().count() == items.select("external_id").distinct().count()
