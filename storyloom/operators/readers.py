"""Reader views: topics of readers joined with stories."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from storyloom.functions import text as X
from storyloom.functions import vectors as V
from storyloom.operators import search
from storyloom.session import cut_lineage

FIT_FLOOR, EVENT_FLOOR, NEW_HOURS, BUSY_WEEK = 0.62, 0.82, 48, 300
SUGGESTED_SOURCES, RELATED_PLACES, LATEST_TITLES = 8, 4, 3
BLOCK_ROWS, SEARCH_ROWS = 2048, 1024


def places(story_topics: DataFrame, tree: DataFrame) -> DataFrame:
    """Every place a story is in: where it was filed and all topics above."""
    return story_topics.join(tree, "slug").select("story_id", F.col("ancestor").alias("place")).distinct()


def _close(queries: DataFrame, stories: DataFrame, floor: float) -> DataFrame:
    """(key, story_id, score) for stories at least ``floor`` from a query vector.

    A configuration-sized set of queries is one matrix on every worker. A larger
    one is met in tiles of two bounded blocks. Only what reaches the floor is
    written either way.
    """
    found = V.collect_matrix(queries, "key", "vector")
    if found is not None:
        keys, matrix = found
        result = T.StructType([T.StructField("key", queries.schema["key"].dataType), T.StructField("story_id", T.LongType()), T.StructField("score", T.DoubleType())])
        if not keys:
            return stories.sparkSession.createDataFrame([], result)
        schema = to_arrow_schema(result)

        def search(batches):
            names = pa.array(keys, schema.field("key").type)
            for batch in batches:
                for at in range(0, batch.num_rows, SEARCH_ROWS):
                    rows = batch.slice(at, SEARCH_ROWS)
                    rows = rows.filter(rows.column("centroid").is_valid())
                    if rows.num_rows:
                        scores = V.as_matrix(rows.column("centroid")) @ matrix.T
                        s, q = np.nonzero(scores >= floor)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), rows.column("story_id").take(pa.array(s)), pa.array(scores[s, q])], schema=schema)

        return stories.select("story_id", "centroid").mapInArrow(search, result)
    return close_in_tiles(queries, stories, floor)


def close_in_tiles(queries: DataFrame, stories: DataFrame, floor: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same matches by block against block."""
    key_type = queries.schema["key"].dataType
    result = T.StructType([T.StructField("key", key_type), T.StructField("story_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def meet(tile: pa.Table) -> pa.Table:
        is_query = tile.column("is_query")
        asked, held = tile.filter(is_query), tile.filter(pc.invert(is_query))
        if asked.num_rows and held.num_rows:
            scores = V.as_matrix(asked.column("vector")) @ V.as_matrix(held.column("vector")).T
        else:
            scores = np.zeros((asked.num_rows, held.num_rows))
        q, s = np.nonzero(scores >= floor)
        return pa.table({"key": asked.column("key").take(pa.array(q)), "story_id": held.column("story_id").take(pa.array(s)), "score": scores[q, s]})

    blocks = lambda df: max(1, -(-df.count() // block_rows))
    n_q, n_s = blocks(queries), blocks(stories)
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = queries.select("key", F.lit(None).cast("long").alias("story_id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("is_query"),
                          F.pmod(F.xxhash64("key"), F.lit(n_q)).cast("int").alias("qb"), spread("sb", n_s))
    right = stories.select(F.lit(None).cast(key_type).alias("key"), "story_id", F.col("centroid").cast("array<double>").alias("vector"), F.lit(False).alias("is_query"),
                           spread("qb", n_q), F.pmod(F.xxhash64("story_id"), F.lit(n_s)).cast("int").alias("sb"))
    return left.unionByName(right).groupBy("qb", "sb").applyInArrow(meet, result)


def nearby(chosen: DataFrame, centroids: DataFrame, floor: float = FIT_FLOOR) -> DataFrame:
    """(story_id, near): stories around each chosen one, itself included."""
    queries = centroids.join(chosen.select("story_id"), "story_id", "left_semi").select(F.col("story_id").alias("key"), F.col("centroid").alias("vector"))
    around = _close(queries, centroids, floor).select(F.col("key").alias("story_id"), F.col("story_id").alias("near"))
    return around.unionByName(chosen.select("story_id", F.col("story_id").alias("near"))).distinct()


def example_vectors(examples: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """Per topic (or reader) the mean direction of its example stories, as packed numbers."""
    rows = examples.join(centroids, examples["example"] == centroids["story_id"])
    return V.mean_direction(rows, [key], "centroid", "vector")


def story_texts(cards: DataFrame, story_items: DataFrame, items: DataFrame) -> DataFrame:
    """(story_id, text): what a name is looked for in, a row for the card's title and summary and one for each item's title."""
    shown = cards.select("story_id", F.concat_ws(" ", "title", "summary").alias("text"))
    return shown.unionByName(story_items.join(items.select("item_id", F.col("title").alias("text")), "item_id").select("story_id", "text"))


def story_words(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(story_id, word): asked words that occur whole or as a plural in a story."""
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    seen = texts.select("story_id", F.explode(tokens).alias("token"))
    singular = F.explode(F.array_compact(F.array(
        F.col("token"),
        F.when(F.endswith("token", F.lit("s")), F.col("token").substr(F.lit(1), F.length("token") - 1)),
        F.when(F.endswith("token", F.lit("es")), F.col("token").substr(F.lit(1), F.length("token") - 2)),
    )))
    return seen.select("story_id", singular.alias("word")).join(asked, "word", "left_semi").distinct()


#: Stories of a word that one key of a join holds; a more frequent word is dealt to several.
POSTINGS = 50_000


def named_in(names: DataFrame, texts: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """(name, story_id): every word of the name occurs somewhere in the story.

    Words have lists of the stories that hold them. A name starts from the list of
    its rarest word; the stories found there are then looked up, word and story
    together, in the lists of its other words. So no list longer than the rarest is
    read for a name, and a list that is long all the same is dealt by story.
    """
    split = names.select("name").distinct().select("name", F.array_distinct(X.words(F.col("name"))).alias("w"))
    asked = split.select("name", F.size("w").alias("needed"), F.explode("w").alias("word"))
    lists = cut_lineage(story_words(texts, asked.select("word").distinct()))
    length = lists.groupBy("word").agg(F.count("*").alias("stories")).select("word", "stories", F.ceil(F.col("stories") / postings).alias("parts"))
    known = asked.join(length, "word").groupBy("name", "needed").agg(
        F.min_by(F.struct("word", "parts"), F.struct("stories", "word")).alias("rarest"), F.collect_list("word").alias("w"))
    known = known.where(F.size("w") == F.col("needed"))
    start = known.select("name", "rarest.word", F.array_remove("w", F.col("rarest.word")).alias("others"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("rarest.parts") - 1)).alias("part"))
    dealt = lists.join(length.select("word", "parts"), "word").select("word", "story_id", F.pmod(F.xxhash64("story_id"), F.col("parts")).alias("part"))
    first = start.join(dealt, ["word", "part"]).select("name", "story_id", "others")
    single = first.where(F.size("others") == 0).select("name", "story_id")
    looked = first.where(F.size("others") > 0).select("name", "story_id", F.size("others").alias("left"), F.explode("others").alias("word"))
    met = looked.join(lists, ["word", "story_id"]).groupBy("name", "story_id", "left").agg(F.count("*").alias("met"))
    return single.unionByName(met.where(F.col("met") == F.col("left")).select("name", "story_id"))


def defined(topics: DataFrame, examples: DataFrame) -> DataFrame:
    """``topics`` with ``definition``: what decides which stories fit, shared by the topics that say the same.

    A topic is defined in one way: by its examples (``taught``, the sorted ones), else by its place, else by its name.
    """
    taught = examples.groupBy("topic_key").agg(F.array_sort(F.collect_set("example")).alias("taught"))
    rows = topics.join(taught, "topic_key", "left")
    return rows.withColumn("definition", F.when(F.col("taught").isNotNull(), F.concat(F.lit("e:"), F.array_join("taught", ",")))
                           .when(F.col("spine").isNotNull(), F.concat(F.lit("s:"), "spine")).otherwise(F.concat(F.lit("n:"), "name")))


def like_examples(definitions: DataFrame, centroids: DataFrame, floor: float = EVENT_FLOOR) -> DataFrame:
    """(definition, story_id): the examples (``definitions``: definition, example), and what comes close to their mean direction."""
    vectors = example_vectors(definitions, centroids, "definition")
    near = _close(vectors.select(F.col("definition").alias("key"), "vector"), centroids, floor)
    return near.select(F.col("key").alias("definition"), "story_id").unionByName(
        definitions.select("definition", F.col("example").alias("story_id"))).distinct()


def fits_definitions(rows: DataFrame, story_places: DataFrame, texts: DataFrame, centroids: DataFrame, event_floor: float = EVENT_FLOOR) -> DataFrame:
    """(definition, story_id) of every story that fits a definition of ``defined`` topics; each is tested once, however many topics share it."""
    taught = rows.where("taught IS NOT NULL").select("definition", F.explode("taught").alias("example")).distinct()
    placed = rows.where("taught IS NULL AND spine IS NOT NULL").select("definition", F.col("spine").alias("place")).distinct()
    named = rows.where("taught IS NULL AND spine IS NULL").select("definition", "name").distinct()
    return like_examples(taught, centroids, event_floor).unionByName(placed.join(story_places, "place").select("definition", "story_id")).unionByName(
        named.join(named_in(named, texts), "name").select("definition", "story_id"))


#: Stories or topics that one list holds, about, and rows that one task writes from them.
LIST_ROWS, TASK_ROWS = 1024, 4_000_000
#: Rows of an offer in several ways are dealt to this many lists.
MIXED_LISTS = 64


def offers(asking: DataFrame, fitting: DataFrame, wanted: tuple[str, ...] = (), tested: tuple[str, ...] = (), keep: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """What topics ask for, and what there is of it: (..., offer) and (offer, stories).

    ``asking`` has topics, their sorted definitions ``says`` and what else they want
    (``wanted``, arrays); topics that say and want the same share an offer, which meets
    the stories once. ``fitting`` (definition, story_id, ...) comes as lists of bounded
    length; an offer takes from a list what ``keep`` leaves, which reads the columns
    ``tested`` of a story. No story is twice in an offer.
    """
    rest = [c for c in fitting.columns if c != "definition"]
    fitting = cut_lineage(fitting)
    told = cut_lineage(asking.select("says", *wanted).distinct().withColumn("offer", F.monotonically_increasing_id()))
    takers = cut_lineage(asking.join(told, ["says", *wanted]).drop("says", *wanted))
    # The lists of a definition are as many as its length asks for, so that a long one is no single row of the join.
    lists = fitting.groupBy("definition").agg(F.ceil(F.count("*") / LIST_ROWS).alias("lists"))
    dealt = fitting.join(lists, "definition").withColumn("list", F.pmod(F.xxhash64("story_id"), F.col("lists")))
    held = dealt.groupBy("definition", "list").agg(F.collect_list(F.struct(*rest)).alias("stories"))

    def met(some: DataFrame) -> DataFrame:
        rows = some.select("offer", F.explode("says").alias("definition"), *wanted).join(held, "definition")
        taken = F.col("stories") if keep is None else F.filter("stories", keep)
        kept = rows.select("offer", taken.alias("stories")).where(F.size("stories") > 0)
        return kept.select("offer", F.transform("stories", lambda s: F.struct(*[s[c].alias(c) for c in rest if c not in tested])).alias("stories"))

    several = met(told.where(F.size("says") > 1)).select("offer", F.explode("stories").alias("story")).distinct()
    mixed = several.groupBy("offer", F.pmod(F.xxhash64("story.story_id"), F.lit(MIXED_LISTS))).agg(F.collect_list("story").alias("stories"))
    return takers, met(told.where(F.size("says") == 1)).unionByName(mixed.select("offer", "stories"))


def taken(takers: DataFrame, offered: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every topic of ``takers`` with every story of its offer.

    The rows are as many as there are pairs, so they are made where they are read:
    lists of topics meet lists of stories, and only the lists are moved.
    """
    return _met(takers, cut_lineage(offered), task_rows)


def _met(takers: DataFrame, offered: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``taken`` of lists that are written."""
    columns = [c for c in takers.columns if c != "offer"]
    lists = takers.groupBy("offer").agg(F.ceil(F.count("*") / LIST_ROWS).alias("lists"))
    dealt = takers.join(lists, "offer").groupBy("offer", F.pmod(F.xxhash64(*columns), F.col("lists")).alias("list"))
    asking = cut_lineage(dealt.agg(F.collect_list(F.struct(*columns)).alias("topics")).select("offer", "topics"))
    count = lambda rows, of: rows.groupBy("offer").agg(F.sum(F.size(of).cast("long")).alias(of))
    pairs = count(asking, "topics").join(count(offered, "stories"), "offer").agg(F.sum(F.col("topics").cast("double") * F.col("stories"))).first()[0]
    met = asking.join(offered, "offer").select("topics", "stories").repartition(max(1, math.ceil((pairs or 0) / task_rows)))
    topics = met.select(F.explode("topics").alias("t"), "stories").select("t.*", "stories")
    return topics.select(*columns, F.explode("stories").alias("s")).select(*columns, "s.*")


def _said(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per topic its definitions; one that is listed twice may have several."""
    said = rows.where("definition IS NOT NULL").groupBy(*keys)
    return said.agg(F.array_sort(F.collect_set("definition")).alias("says"))


def fits(topics: DataFrame, examples: DataFrame, story_places: DataFrame, texts: DataFrame, centroids: DataFrame,
         event_floor: float = EVENT_FLOOR, fit_floor: float = FIT_FLOOR) -> DataFrame:
    """(topic_key, story_id) of every story that fits a topic; a named topic with a vector also takes what is near that.

    A vector is a definition too: topics that point the same way are tested once.
    """
    rows = defined(topics, examples)
    found = fits_definitions(rows, story_places, texts, centroids, event_floor)
    said = rows.select("topic_key", "definition")
    if "vector" in topics.columns:
        way = F.concat(F.lit("v:"), F.sha2(F.to_json("vector"), 256))
        pointed = rows.where("taught IS NULL AND spine IS NULL AND vector IS NOT NULL").select("topic_key", "vector", way.alias("definition"))
        ways = pointed.groupBy(F.col("definition").alias("key")).agg(F.first("vector").alias("vector"))
        near = _close(ways, centroids, fit_floor)
        found = found.unionByName(near.select(F.col("key").alias("definition"), "story_id"))
        said = said.unionByName(pointed.select("topic_key", "definition"))
    return taken(*offers(_said(said, ["topic_key"]), found))


def _shared(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def topic_offers(topics: DataFrame, examples: DataFrame, story_places: DataFrame, texts: DataFrame, centroids: DataFrame, topic_sources: DataFrame,
                 story_sources: DataFrame, cards: DataFrame, muted: DataFrame, event_floor: float = EVENT_FLOOR) -> tuple[DataFrame, DataFrame]:
    """(reader, topic_key, offer) and (offer, stories): fitting stories from a source the topic takes, without its muted words.

    What ``cards`` has beside title and summary stays with a story. Each distinct muted
    word is looked for once, all of them in one pass over the cards.
    """
    rows = cut_lineage(defined(topics, examples).select("reader", "topic_key", "definition", "taught", "spine", "name"))
    literal = F.regexp_replace(F.col("word"), r"([\\%_])", r"\\$1")
    words = muted.where("word <> ''").select("topic_key", literal.alias("key"))
    kept = [c for c in cards.columns if c not in ("title", "summary")]
    hits = search.matches(words, cards.select(F.col("story_id").alias("id"), F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))).alias("text")))
    by = story_sources.groupBy("story_id").agg(F.collect_set("source").alias("by"))
    held = hits.groupBy(F.col("id").alias("story_id")).agg(F.collect_set("key").alias("held"))
    about = by.join(held, "story_id", "left")
    about = about.join(cards.select(*kept), "story_id") if len(kept) > 1 else about
    fitting = fits_definitions(rows, story_places, texts, centroids, event_floor).join(about, "story_id")
    sources = topic_sources.groupBy("topic_key").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    unwanted = words.groupBy("topic_key").agg(F.array_sort(F.collect_set("key")).alias("unwanted"))
    asking = _said(rows, ["reader", "topic_key"]).join(sources, "topic_key").join(unwanted, "topic_key", "left")
    asking = asking.withColumn("unwanted", F.coalesce("unwanted", F.array().cast("array<string>")))
    fine = lambda s: _shared(s["by"], F.col("sources")) & ~_shared(s["held"], F.col("unwanted"))
    return offers(asking, fitting, ("sources", "unwanted"), ("by", "held"), fine)


def in_topic(topics: DataFrame, examples: DataFrame, story_places: DataFrame, texts: DataFrame, centroids: DataFrame, topic_sources: DataFrame,
             story_sources: DataFrame, cards: DataFrame, muted: DataFrame, event_floor: float = EVENT_FLOOR) -> DataFrame:
    """(reader, topic_key, story_id): the stories of every topic."""
    found = topic_offers(topics, examples, story_places, texts, centroids, topic_sources, story_sources, cards.select("story_id", "title", "summary"), muted, event_floor)
    return taken(*found).select("reader", "topic_key", "story_id")


def fresh(published: Column, now: int) -> Column:
    """Younger than two days."""
    return F.coalesce(now - published < NEW_HOURS * 3600, F.lit(False))


def is_new(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of (reader, story, fresh) with a flag: unread and fresh. Only the fresh ones are asked for in the readers' marks."""
    marks = seen.select("reader", "story_id").distinct().withColumn("read", F.lit(True))
    young = rows.where("fresh").join(marks, ["reader", "story_id"], "left").withColumn("is_new", F.col("read").isNull()).drop("read")
    return young.unionByName(rows.where("NOT fresh").withColumn("is_new", F.lit(False))).drop("fresh")


#: Fresh stories read by one reader that go with a topic to where its rows are made.
MARKS_IN_PLACE = 64


def new_rows(takers: DataFrame, offered: DataFrame, seen: DataFrame, in_place: int = MARKS_IN_PLACE) -> DataFrame:
    """``is_new`` of every topic with every story of its offer, without moving the rows.

    What a reader has read of an offer's fresh stories is found from the marks and goes with
    the topic, so the flag is made where the rows are. Topics with more than ``in_place``
    such marks are asked row by row.
    """
    offered = cut_lineage(offered)
    young = offered.select("offer", F.explode("stories").alias("s")).where("s.fresh").select("offer", "s.story_id")
    marks = seen.select("reader", "story_id").distinct().join(young.select("story_id").distinct(), "story_id", "left_semi")
    read = takers.join(marks, "reader").join(young, ["offer", "story_id"]).groupBy("reader", "topic_key", "offer").agg(F.collect_list("story_id").alias("read"))
    asked = cut_lineage(takers.join(read, ["reader", "topic_key", "offer"], "left"))
    many = F.coalesce(F.size("read") > in_place, F.lit(False))
    known = F.coalesce(F.array_contains("read", F.col("story_id")), F.lit(False))
    here = _met(asked.where(~many), offered).withColumn("is_new", F.col("fresh") & ~known).drop("read", "fresh")
    return here.unionByName(is_new(_met(asked.where(many).drop("read"), offered), seen))


def new_counts(takers: DataFrame, offered: DataFrame, seen: DataFrame) -> DataFrame:
    """(topic_key, new, stories): how many stories of a topic there are, and how many of them are fresh and unread.

    Counted per offer; from the fresh stories of a topic those its reader has read
    are taken off, found from the marks, so no topic meets all of its stories.
    """
    offered = cut_lineage(offered)
    story = offered.select("offer", F.explode("stories").alias("s")).select("offer", "s.story_id", "s.fresh")
    counts = offered.groupBy("offer").agg(
        F.sum(F.size("stories").cast("long")).alias("stories"), F.sum(F.size(F.filter("stories", lambda s: s["fresh"])).cast("long")).alias("fresh"))
    young = story.where("fresh").select("offer", "story_id")
    marks = seen.select("reader", "story_id").distinct().join(young.select("story_id").distinct(), "story_id", "left_semi")
    read = takers.join(marks, "reader").join(young, ["offer", "story_id"]).groupBy("topic_key").agg(F.count("*").alias("read"))
    each = takers.join(counts, "offer").groupBy("topic_key").agg(F.sum("fresh").alias("fresh"), F.sum("stories").alias("stories"))
    return each.join(read, "topic_key", "left").select("topic_key", (F.col("fresh") - F.coalesce("read", F.lit(0))).alias("new"), "stories")


def read_order(takers: DataFrame, offered: DataFrame) -> DataFrame:
    """(reader, story_id, published_s): the distinct stories of each reader, newest first.

    Readers with the same offers share one list, cut into runs by time; lists are put in order by reader and
    run, and the stories inside where they are read.
    """
    asked = takers.groupBy("reader").agg(F.array_sort(F.collect_set("offer")).alias("offers"))
    told = cut_lineage(asked.select("offers").distinct().withColumn("feed", F.monotonically_increasing_id()))
    feeds = asked.join(told, "offers").select("reader", "feed")
    offered = cut_lineage(offered)
    each = told.select("feed", F.size("offers").alias("n"), F.explode("offers").alias("offer")).join(offered, "offer").select("feed", "n", F.explode("stories").alias("s"))
    each = each.select("feed", "n", "s.story_id", "s.published_s")
    rows = each.where("n = 1").unionByName(each.where("n > 1").distinct()).drop("n")
    sizes = rows.groupBy("feed").agg(F.count("*").alias("n"), F.min("published_s").alias("first"), F.max("published_s").alias("last"))
    # Spans of time that hold a list's worth on average; stories without a time are in no order and dealt.
    span = F.greatest(F.lit(1), F.floor((F.col("last") - F.col("first")) * LIST_ROWS / F.col("n")))
    deal = F.when(F.col("published_s").isNull(), F.pmod(F.xxhash64("story_id"), F.ceil(F.col("n") / LIST_ROWS)))
    cut = rows.join(sizes, "feed").select("feed", "story_id", "published_s", F.floor(F.col("published_s") / span).alias("run"), deal.alias("deal"))
    runs = cut.groupBy("feed", "run", "deal").agg(F.array_sort(F.collect_list(F.struct((-F.col("published_s")).alias("minus"), "story_id"))).alias("stories"))
    lists = runs.select("feed", "run", F.transform("stories", lambda s: s["story_id"]).alias("ids"), F.transform("stories", lambda s: -s["minus"]).alias("times"))
    ordered = feeds.join(lists, "feed").orderBy("reader", F.desc_nulls_last("run"))
    pairs = ordered.select("reader", F.explode(F.arrays_zip("ids", "times")).alias("s"))
    return pairs.select("reader", F.col("s.ids").alias("story_id"), F.col("s.times").alias("published_s"))


def following(topics: DataFrame, tree: DataFrame) -> DataFrame:
    """(reader, place, state): followed itself (own), or inside a followed topic (via)."""
    spine = topics.where("spine IS NOT NULL").select("reader", F.col("spine").alias("ancestor"))
    reach = spine.join(tree, "ancestor").groupBy("reader", F.col("slug").alias("place")).agg(F.min("distance").alias("nearest"))
    return reach.select("reader", "place", F.when(F.col("nearest") == 0, "own").otherwise("via").alias("state"))


def catalogue(items: DataFrame, story_items: DataFrame, now: int) -> DataFrame:
    """Per source: items of the last week and its newest distinct titles."""
    rows = items.join(story_items.select("item_id"), "item_id", "left_semi")
    week = rows.groupBy("source").agg(F.count_if(F.col("at") > now - 7 * 86400).alias("week"))
    titles = rows.groupBy("source", "title").agg(F.max("at").alias("newest"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("newest"), "title"))
    top = titles.withColumn("place", place).where(F.col("place") <= LATEST_TITLES)
    latest = top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda t: t["title"]).alias("latest"))
    return week.join(latest, "source")


def busy(rows: DataFrame, at_least: int = BUSY_WEEK) -> DataFrame:
    """The sources of a catalogue that bring so many items a week that a topic should take them with care."""
    return rows.where(F.col("week") >= at_least)


def source_places(story_sources: DataFrame, story_places: DataFrame) -> DataFrame:
    """Stories each source put in each place."""
    return story_sources.join(story_places, "story_id").groupBy("source", "place").agg(F.count("*").alias("stories"))


def sources_for(counts: DataFrame) -> DataFrame:
    """Each place's sources, busiest first, numbered."""
    order = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("stories"), "source"))
    return counts.withColumn("position", order)


def rank_sources(sets: DataFrame, story_sources: DataFrame, catalogue_rows: DataFrame, limit: int = SUGGESTED_SOURCES) -> DataFrame:
    """The sources of each story set: most stories, then busiest week, then name."""
    counts = sets.join(story_sources, "story_id").groupBy("set", "source").agg(F.count("*").alias("stories"))
    order = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("stories"), F.desc("week"), "source"))
    return counts.join(catalogue_rows, "source").withColumn("position", order).where(F.col("position") <= limit)


def related_places(sets: DataFrame, story_topics: DataFrame, limit: int = RELATED_PLACES) -> DataFrame:
    """Where the stories of each set are filed, most first."""
    counts = sets.join(story_topics, "story_id").groupBy("set", "slug").agg(F.count("*").alias("stories"))
    order = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("stories"), "slug"))
    return counts.withColumn("position", order).where(F.col("position") <= limit)


def for_subjects(subjects: DataFrame, centroids: DataFrame, floor: float) -> DataFrame:
    """(set, story_id): stories that fit each subject vector."""
    return _close(subjects, centroids, floor).select(F.col("key").alias("set"), "story_id")


def profile_rows(topics: DataFrame, topic_sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Each reader's topics with their sources, and how much was read."""
    taken = topic_sources.groupBy("topic_key").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    read = seen.select("reader", "story_id").distinct().groupBy("reader").agg(F.count("*").alias("stories_seen"))
    return topics.join(taken, "topic_key", "left").join(read, "reader", "left").withColumn("stories_seen", F.coalesce("stories_seen", F.lit(0)))


def read_marks(events: DataFrame) -> DataFrame:
    """(reader, story_id) read: shown, then passed, or shown before an end was reached.

    Rows are (reader, story_id, action, seq) with action shown, passed or end;
    an end belongs to the reader, not to a story.
    """
    stories = events.where("action IN ('shown', 'passed')").groupBy("reader", "story_id").agg(
        F.min(F.when(F.col("action") == "shown", F.col("seq"))).alias("first_shown"),
        F.max(F.when(F.col("action") == "passed", F.col("seq"))).alias("last_passed"),
    ).where("first_shown IS NOT NULL")
    ends = events.where("action = 'end'").groupBy("reader").agg(F.max("seq").alias("last_end"))
    rows = stories.join(ends, "reader", "left")
    read = (F.col("last_passed") > F.col("first_shown")) | (F.col("last_end") > F.col("first_shown"))
    return rows.where(F.coalesce(read, F.lit(False))).select("reader", "story_id")


def save_topics(stored: DataFrame, sent: DataFrame, centroids: DataFrame, embed) -> DataFrame:
    """Topics after a save: cleaned text; the vector of the examples, else the one
    kept for an unchanged description, else the description embedded."""
    clean = sent.select(
        "reader", F.coalesce("key", X.slug(F.col("name"))).alias("key"), F.substring(F.btrim("name"), 1, 40).alias("name"),
        F.btrim(F.coalesce("description", "name")).alias("description"), "spine", "example",
        F.filter(F.transform("muted", lambda w: F.btrim(w)), lambda w: w != "").alias("muted"),
    ).where("name <> ''")
    taught = centroids.select(F.col("story_id").alias("example"), V.packed(F.col("centroid")).alias("by_example"))
    before = stored.select("reader", "key", F.col("description").alias("old_description"), F.col("vector").alias("old_vector"))
    rows = clean.join(before, ["reader", "key"], "left").join(taught, "example", "left")
    kept = F.when(F.col("old_description") == F.col("description"), F.col("old_vector"))
    settled = rows.withColumn("vector", F.coalesce("by_example", kept))
    fresh = V.packed(embed(F.when(F.col("vector").isNull() & F.col("spine").isNull(), F.col("description"))))
    return settled.withColumn("vector", F.coalesce("vector", F.when(F.col("spine").isNull(), fresh))).select(
        "reader", "key", "name", "description", "spine", "example", "muted", "vector")
