"""The incremental forms of the batch jobs, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from storyloom.functions import items as I
from storyloom.operators import cluster, feed, ingest
from storyloom.session import scratch


def stream_of(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, be it one file or a folder of them; each file is delivered once."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream takes a single file only by a pattern; this one matches the table's path alone.
    return reader.parquet(f"{folder}/{name}.parque[t]")


def drain(stream: DataFrame, checkpoint: str, sink: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process everything available and stop; a later call goes on where this ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        writer = writer.foreachBatch(each)
    else:
        writer = writer.format("parquet").option("path", sink)
    query = writer.start()
    query.awaitTermination()


class Versions:
    """A table kept as one folder per micro-batch.

    A batch reads the newest version before its own and writes its own, so a
    replayed batch replaces what its first try left behind.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._fs = None

    def _numbers(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        # Only a version whose write was committed counts.
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def before(self, batch: int | None = None) -> DataFrame | None:
        older = [n for n in self._numbers() if batch is None or n < batch]
        return self.spark.read.parquet(f"{self.folder}/v={older[-1]}") if older else None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v={batch}")


def ingest_stream(deliveries: DataFrame, store: Versions, checkpoint: str, now: int, max_age_days: int = ingest.MAX_ITEM_AGE_DAYS, first: int = 0) -> None:
    """Upsert every micro-batch into the item store; delivering again changes nothing.

    A stream that goes on in a store another one filled numbers its versions
    from ``first``.
    """

    def each(batch: DataFrame, number: int) -> None:
        number += first
        stored = store.before(number)
        if stored is None:
            columns = [*ingest.IDENTITY, *ingest.CONTENT]
            stored = batch.select(*columns).limit(0).select(
                *columns, F.lit("").alias("content_hash"), F.lit("").alias("triage_state"),
                F.lit(None).cast("double").alias("triage_score"), F.lit(None).cast("string").alias("embedded_hash"))
        store.write(ingest.upsert(stored, ingest.classify(batch, stored, now, max_age_days)), number)

    drain(deliveries, checkpoint, each=each)


def outcome_counts(deliveries: DataFrame, stored: DataFrame, now: int, max_age_days: int, sink: Versions, checkpoint: str) -> None:
    """Late items are counted as stale, not stored: running totals per outcome."""
    known = stored.select(*ingest.IDENTITY, F.lit(True).alias("known"))
    late = F.coalesce(F.col("published_s") < now - max_age_days * 86400, F.lit(False))
    outcome = F.when(F.col("known").isNotNull(), "known").when(late, "stale").otherwise("inserted")
    totals = deliveries.join(known, ingest.IDENTITY, "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    drain(totals, checkpoint, each=lambda batch, number: sink.write(batch, number), mode="complete")


def cluster_stream(arrivals: DataFrame, identifiers: DataFrame, store: Versions, checkpoint: str, merge: float, ambiguous: float, window_days: int) -> None:
    """Assign each micro-batch of (item_id, at, embedding) to stories.

    What is stored meets the batch through two joins: every stored item by
    identifier, and by similarity only those a window of the batch can reach.
    """

    def each(batch: DataFrame, number: int) -> None:
        stored = store.before(number)
        new = batch.select("item_id", "at", "embedding").withColumn("batch", F.lit(1))
        if stored is None:
            assigned = cluster.assign(new, identifiers, None, merge, ambiguous, window_days)
            kept = None
        else:
            fresh = new.join(stored.select("item_id"), "item_id", "left_anti")
            old = stored.select("item_id", "at", "embedding").withColumn("batch", F.lit(0))
            known = stored.select("item_id", "story_id")
            assigned = cluster.assign(old.unionByName(fresh), identifiers, known, merge, ambiguous, window_days)
            kept = stored
        rows = assigned.join(batch.select("item_id", "at", "embedding"), "item_id").select("item_id", "at", "embedding", "story_id", "how", "score")
        store.write(rows if kept is None else kept.unionByName(rows), number)

    drain(arrivals, checkpoint, each=each)


def wake_stream(arrivals: DataFrame, story_items: DataFrame, items: DataFrame, stories: DataFrame, store: Versions, checkpoint: str) -> None:
    """Keep story aggregates fresh: only stories an arrival touches are computed again."""

    def each(batch: DataFrame, number: int) -> None:
        touched = story_items.join(batch.select("item_id"), "item_id", "left_semi").select("story_id").distinct()
        fresh = feed.aggregates(stories.join(touched, "story_id", "left_semi"), story_items, items)
        before = store.before(number)
        store.write(fresh if before is None else before.join(touched, "story_id", "left_anti").unionByName(fresh), number)

    drain(arrivals, checkpoint, each=each)


class ReadMarks(StatefulProcessor):
    """Per reader: which shown stories were since passed, or left above an end reached.

    Independent of the order of rows within a batch: a story is read once the
    last pass or end comes after its first showing. State is a map in the state
    store, so a busy reader does not have to fit in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        story = StructType([StructField("story_id", LongType())])
        marks = StructType([StructField("shown", LongType()), StructField("passed", LongType()), StructField("done", BooleanType())])
        self.stories = handle.getMapState("stories", story, marks)
        self.end = handle.getValueState("end", StructType([StructField("seq", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reader, read = key[0], []
        end = self.end.get()[0] if self.end.exists() else -1
        latest = end
        for batch in rows:
            ends = batch.loc[batch["action"] == "end", "seq"]
            if len(ends):
                latest = max(latest, int(ends.max()))
            # One pass over the batch; the state is asked only where the reader has some, and told only what changed.
            first, last = (batch[batch["action"] == action].dropna(subset=["story_id", "seq"]).groupby("story_id")["seq"] for action in ("shown", "passed"))
            firsts, lasts = first.min().to_dict(), last.max().to_dict()
            some = self.stories.exists()
            for story in firsts.keys() | lasts.keys():
                at = (int(story),)
                held = self.stories.getValue(at) if some and self.stories.containsKey(at) else (None, None, False)
                shown, passed, done = held
                if story in firsts:
                    shown = int(firsts[story]) if shown is None else min(shown, int(firsts[story]))
                if story in lasts:
                    passed = int(lasts[story]) if passed is None else max(passed, int(lasts[story]))
                now_read = shown is not None and max(passed if passed is not None else -1, latest) > shown
                if now_read and not done:
                    read.append(int(story))
                if (shown, passed, done or now_read) != tuple(held):
                    self.stories.updateValue(at, (shown, passed, done or now_read))
        if latest > end:
            self.end.update((latest,))
            for (story,), (shown, passed, done) in list(self.stories.iterator()):
                if not done and shown is not None and latest > shown:
                    read.append(int(story))
                    self.stories.updateValue((int(story),), (shown, passed, True))
        yield pd.DataFrame({"reader": pd.Series([reader] * len(read), dtype="int64"), "story_id": pd.Series(read, dtype="int64")})

    def close(self) -> None:
        pass


def read_mark_stream(impressions: DataFrame, sink: str, checkpoint: str) -> None:
    """Append (reader, story_id) the moment a story counts as read."""
    spark = impressions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marks = impressions.groupBy("reader").transformWithStateInPandas(
        statefulProcessor=ReadMarks(), outputStructType="reader long, story_id long", outputMode="Append", timeMode="None")
    drain(marks, checkpoint, sink)


def hashed_items(stream: DataFrame) -> DataFrame:
    """Items of a stream with their content hash: a stateless projection."""
    return stream.withColumn("content_hash", I.content_hash())


def scratch_pair(spark: SparkSession, name: str) -> tuple[str, str]:
    """(checkpoint, output) folders for one run of a streaming query."""
    base = scratch(spark, name)
    return f"{base}/checkpoint", f"{base}/out"
