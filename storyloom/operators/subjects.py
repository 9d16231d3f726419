"""Grouping recent stories by subject, for a person to name.

The pass takes stories newest first; each joins the group whose running mean it
is nearest to, or opens one. The outcome depends on the order, so the whole pass
is one task at every size, over the stories of a few days. They come to it as a
sorted stream; it holds the groups' sums and means only. Its time grows with
stories times groups, and more machines do not shorten it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import vectors as V
from storyloom.operators.topics import GROUP_SIMILARITY
from storyloom.session import cut_lineage

CHUNK, MIN_SIZE, DAYS = 2048, 3, 7


def _pass(floor: float, chunk: int):
    schema = pa.schema([("story_id", pa.int64()), ("leader", pa.int64())])

    def run(batches):
        heads = running = None
        leaders: list[int] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, taken = batch.column("story_id").to_pylist(), []
            for member, total in zip(ids, V.as_matrix(batch.column("centroid"))):
                if heads is None:
                    heads, running = np.zeros((chunk, len(total))), np.zeros((chunk, len(total)))
                scores = heads[:len(leaders)] @ (total / (np.linalg.norm(total) or 1.0))
                fit = np.flatnonzero(scores >= floor)
                if len(fit):
                    # Among equals the group opened last.
                    g = fit[len(fit) - 1 - int(np.argmax(scores[fit][::-1]))]
                else:
                    g = len(leaders)
                    leaders.append(member)
                    if g == len(heads):
                        more = np.zeros((max(chunk, g // 2), len(total)))
                        heads, running = np.vstack([heads, more]), np.vstack([running, more])
                running[g] += total
                heads[g] = running[g] / (np.linalg.norm(running[g]) or 1.0)
                taken.append(leaders[g])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(taken, pa.int64())], schema=schema)

    return run


def groups(stories: DataFrame, floor: float = GROUP_SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(story_id, leader) for stories of (story_id, newest, centroid); room for groups grows by ``chunk``."""
    rows = stories.select(F.col("story_id").cast("long").alias("story_id"), "newest", "centroid")
    line = rows.repartition(1).sortWithinPartitions(F.desc("newest"), "story_id").select("story_id", "centroid")
    return cut_lineage(line.mapInArrow(_pass(floor, chunk), "story_id long, leader long"))


def candidates(home: DataFrame, story_topics: DataFrame, spine: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Groups large enough to name, those with most stories without a place first."""
    shelves = spine.where("parent IS NOT NULL").select(F.col("parent").alias("slug")).distinct().withColumn("shelf", F.lit(True))
    filed = story_topics.join(shelves, "slug", "left").groupBy("story_id").agg(F.max(F.coalesce("shelf", F.lit(False))).alias("parked"))
    rows = home.join(filed, "story_id", "left")
    counts = rows.groupBy("leader").agg(
        F.count("*").alias("size"), F.count_if(F.col("parked").isNotNull()).alias("claimed"), F.count_if(F.coalesce("parked", F.lit(False))).alias("parked"),
    ).where(F.col("size") >= min_size)
    return counts.withColumn("unplaced", F.col("size") - F.col("claimed") + F.col("parked")).orderBy(F.desc("unplaced"), F.desc("size"), "leader")


def covered(home: DataFrame, story_topics: DataFrame) -> DataFrame:
    """How many stories of each group each topic holds."""
    return home.join(story_topics, "story_id").groupBy("leader", "slug").agg(F.count("*").alias("stories"))
