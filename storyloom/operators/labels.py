"""Facets, entities, and mining new names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import cut_lineage


def member_texts(story_items: DataFrame, items: DataFrame) -> DataFrame:
    """The searchable text of each member of a story.

    Kept one row per member: a story can hold any number of items, and whether
    a story matches is decided by its members' matches.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    return story_items.select("story_id", "item_id").join(items.select("item_id", text.alias("text")), "item_id")


def _hits(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(name)) for name, p in patterns]))


def match(texts: DataFrame, patterns: list[tuple[str, str]], label: str) -> DataFrame:
    """(story_id, label) for every pattern some member's text matches."""
    found = texts.select("story_id", F.explode_outer(_hits(F.col("text"), patterns)).alias(label))
    return found.where(F.col(label).isNotNull()).distinct()


def facet_patterns(facets: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(slug, f"(?iU){pattern}") for slug, pattern in facets]


def entity_pattern(names: list[str]) -> str:
    """Whole names only, longest first; a dot followed by more word continues a word."""
    ordered = sorted(names, key=len, reverse=True)
    return r"(?iU)(?<!\w)(?<!\w\.)(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", n) for n in ordered) + r")(?!\w|\.\w)"


def counts(matches: DataFrame, label: str) -> DataFrame:
    """Stories per label, and under '(any)' the stories carrying one at all."""
    each = matches.groupBy(label).agg(F.count("*").alias("stories"))
    return each.unionByName(matches.select("story_id").distinct().agg(F.count("*").alias("stories")).select(F.lit("(any)").alias(label), "stories"))


def per_story(matches: DataFrame, label: str) -> DataFrame:
    """A story's labels as one sorted list; there are only as many as are configured."""
    return matches.groupBy("story_id").agg(F.array_sort(F.collect_set(label)).alias("labels"))


def sync_entities(stored: DataFrame, seeded: DataFrame) -> DataFrame:
    """Seeded entities take the configured aliases; accepted ones stay as they are."""
    want = seeded.select("kind", "name", F.col("aliases").alias("new"), F.lit(True).alias("seeded"))
    joined = stored.join(want, ["kind", "name"], "full_outer")
    return joined.select("kind", "name", F.when(F.col("seeded"), F.col("new")).otherwise(F.col("aliases")).alias("aliases"))


def entity_stats(entities: DataFrame, matches: DataFrame) -> DataFrame:
    named = matches.groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("stories"))
    return entities.select("kind", "name").join(named, "name", "left").select("kind", "name", F.coalesce("stories", F.lit(0)).alias("stories"))


EXAMPLE_TITLES = 2
# The shape of a name, the marks around a word, words that are not names.
PROPER = r"[A-Z][A-Za-z0-9]*(?:[.\-][A-Za-z0-9]+)*"
EDGES = "()[]{}\"'“”‘’,:;!?"
NOT_NAMES = "abstract announce type tags however english chinese we our".split()


def _tokens(summary: Column) -> Column:
    """Per word of each sentence: the word, its place, whether a mark follows it."""
    edge = re.sub(r"([\[\](){}])", r"\\\1", EDGES)
    sentences = F.split(summary, r"(?U)(?<=[.!?])\s+")

    def of_sentence(sentence: Column) -> Column:
        raw = F.filter(F.split(sentence, r"(?U)\s+"), lambda w: w != "")
        return F.transform(raw, lambda w, i: F.struct(
            F.regexp_replace(w, f"^[{edge}]+|[{edge}]+$", "").alias("word"), i.alias("place"),
            F.regexp_like(w, F.lit(f"[{edge}]$")).alias("marked")))

    def with_previous(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            p = F.get(tokens, i - 1)
            return F.struct(t["word"].alias("word"), t["place"].alias("place"),
                            F.when((i > 0) & ~p["marked"], p["word"]).otherwise(F.lit("")).alias("previous"))
        return F.transform(tokens, one)

    return F.flatten(F.transform(F.transform(sentences, of_sentence), with_previous))


def mine_names(story_items: DataFrame, items: DataFrame, stories: DataFrame, known: list[list[str]], since_day: int,
               min_stories: int = 3, limit: int = 15) -> DataFrame:
    """Proper nouns recurring across recent stories that are not seeded yet, each with the first titles it was met under.

    Words are counted by partial aggregates only; the lists that meet at the
    end have one row per distinct capitalised word.
    """
    recent = stories.where(F.floor(F.col("last_activity") / 86400) >= since_day).select("story_id")
    rows = story_items.join(recent, "story_id", "left_semi").join(items.select("item_id", "title", "summary"), "item_id")
    full = f"^{PROPER}$"
    words = rows.select("story_id", "item_id", F.explode(_tokens(F.coalesce("summary", F.lit("")))).alias("t")).select(
        "story_id", "item_id", "t.word", "t.place", "t.previous").where("word <> ''")
    is_name = (F.col("place") > 0) & F.regexp_like("word", F.lit(full))
    lower_case = ~is_name & (F.col("word") == F.lower("word")) & (F.col("word") != F.upper("word"))
    # The texts are cut into words once for all counts: this keeps a row per lower-case
    # word, and per name, word before and member, and what follows reads the written copy.
    before_it = F.when(is_name & F.regexp_like("previous", F.lit(full)), F.col("previous"))
    of_name = lambda c: F.when(is_name, F.col(c)).alias(c)
    uses = cut_lineage(
        words.where(is_name | lower_case).groupBy("word", is_name.alias("is_name"), before_it.alias("previous"), of_name("story_id"), of_name("item_id"))
        .agg(F.count("*").alias("n"))
    )
    named = uses.where("is_name")
    capital = named.groupBy("word").agg(F.sum("n").alias("times"))
    lower = uses.where("NOT is_name").select(F.col("word").alias("low"), F.col("n").alias("low_times"))
    pairs = named.where("previous IS NOT NULL").groupBy("word", "previous").agg(F.sum("n").alias("n"))
    prefix = pairs.groupBy("word").agg(F.max(F.struct("n", "previous")).alias("b"))
    in_titles = rows.select("story_id", "item_id", F.explode(F.regexp_extract_all("title", F.lit(f"({PROPER})"), F.lit(1))).alias("word"))
    holders = in_titles.unionByName(named.select("story_id", "item_id", "word"))
    spread = holders.select("story_id", "word").distinct().groupBy("word").agg(F.count("*").alias("stories"))

    base = F.split("word", "-")[0]
    base = F.when(F.endswith(base, F.lit("s")) & F.regexp_like(base, F.lit("^[^a-z]*[A-Z][^a-z]*s$")), base.substr(F.lit(1), F.length(base) - 1)).otherwise(base)
    concept = (base == F.upper(base)) & (base != F.lower(base)) & ~F.regexp_like(base, F.lit("[0-9]"))
    seeded = F.lit(False)
    for names in known:
        seeded = seeded | F.regexp_like("word", F.lit(entity_pattern(names)))
    often = capital.where((F.length("word") >= 3) & ~F.lower("word").isin(NOT_NAMES) & ~concept & ~seeded)
    often = often.join(spread.where(F.col("stories") >= min_stories), "word")
    often = often.join(lower, F.lower("word") == F.col("low"), "left").drop("low")
    often = often.where(F.coalesce("low_times", F.lit(0)) <= F.col("times") / 4).drop("low_times")
    paired = often.join(prefix, "word", "left").join(lower, F.lower("b.previous") == F.col("low"), "left")
    usable = (
        F.col("b").isNotNull() & (F.col("b.n") * 2 >= F.col("times")) & ~F.lower("b.previous").isin(NOT_NAMES)
        & (F.coalesce("low_times", F.lit(0)) <= F.col("b.n") / 4)
    )
    name = F.when(usable, F.concat("b.previous", F.lit(" "), "word")).otherwise(F.col("word"))
    taken = F.lit(False)
    for names in known:
        taken = taken | F.regexp_like("name", F.lit("(?iU)^(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", n) for n in names) + ")$"))
    found = paired.select(name.alias("name"), "word", "stories").where(~taken | (F.col("name") == F.col("word")))
    best = cut_lineage(found.orderBy(F.desc("stories"), "name", "word").limit(limit))
    # Of the few chosen words only, the titles they were met under, in reading order.
    met = holders.join(best.select("word"), "word", "left_semi").distinct().join(items.select("item_id", "title").where("title <> ''"), "item_id")
    titles = met.groupBy("word", "title").agg(F.min(F.struct("story_id", "item_id")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("word").orderBy("first", "title"))
    shown = titles.withColumn("nth", nth).where(F.col("nth") <= EXAMPLE_TITLES).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("nth", "title"))).alias("shown"))
    examples = F.coalesce(F.transform("shown", lambda t: t["title"]), F.array().cast("array<string>"))
    return best.join(shown, "word", "left").select("name", "stories", examples.alias("examples")).orderBy(F.desc("stories"), "name")
