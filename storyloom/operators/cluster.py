"""Stories: items joined by identifier, then by similarity in a time window.

An item's parent depends only on which items come before it, never on the story
they ended up in, so the parents form a forest and a story is the tree of its
root. Roots are found by pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators import identity, similarity
from storyloom.session import cut_lineage

MERGE, AMBIGUOUS, WINDOW_DAYS = 0.92, 0.86, 14

# What each kind of item contributes to a story.
KIND_ROLE = {
    "paper": "paper", "repo": "code", "video": "video", "discussion": "discussion",
    "model": "seed", "article": "coverage", "post": "coverage",
}
PRIMARY_KINDS = ("paper", "model", "repo")


def role(kind: Column, opens: Column) -> Column:
    """The opener leads, whatever it is; what comes later only contributes."""
    plain = F.coalesce(*[F.when(kind == k, F.lit(r)) for k, r in KIND_ROLE.items()], F.lit("coverage"))
    return (
        F.when(opens & (plain == "coverage"), "seed")
        .when(~opens & (plain == "seed"), "code").otherwise(plain)
    )


def unclustered(items: DataFrame, vectors: DataFrame, story_items: DataFrame) -> DataFrame:
    """Items with a vector and no story yet."""
    return items.join(vectors.select("item_id", "embedding"), "item_id").join(
        story_items.select("item_id"), "item_id", "left_anti"
    )


def parents(members: DataFrame, identifiers: DataFrame, merge: float, ambiguous: float, window_days: int) -> DataFrame:
    """(item_id, parent, how, score) for every new item.

    ``members`` holds (item_id, batch, at, embedding); batch 0 is what already
    has a story, batch 1 what is new. Only items without an identifier match go
    on to the similarity join.
    """
    order = members.select("item_id", F.struct("batch", "at", "item_id").alias("ord"))
    new = members.where("batch = 1")
    by_key = identity.earliest_sharing(identifiers, order).withColumnRenamed("parent", "key_parent")
    open_ends = new.join(by_key, "item_id", "left_anti")
    close = similarity.best_earlier(open_ends, members, window_days * 86400, ambiguous)
    joined = new.select("item_id").join(by_key, "item_id", "left").join(close, "item_id", "left")
    how = (
        F.when(F.col("key_parent").isNotNull(), "identifier").when(F.col("score") >= merge, "similarity")
        .when(F.col("score") >= ambiguous, "ambiguous").otherwise("new")
    )
    return joined.select(
        "item_id", how.alias("how"), F.col("match").alias("nearest"), "score",
        F.coalesce("key_parent", F.when(F.col("score") >= merge, F.col("match")), F.col("item_id")).alias("parent"),
    )


def roots(parent: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(item_id, root) by pointer jumping: every round halves the depth left.

    Each round is written to the checkpoint folder, so a lost executor costs
    one round. The loop ends when a round changes nothing.
    """
    current = cut_lineage(parent.select("item_id", "parent"))
    for _ in range(max_rounds):
        above = current.select(F.col("item_id").alias("parent"), F.col("parent").alias("up"))
        # Only items still pointing at another item take part in the join.
        settled = current.where(F.col("item_id") == F.col("parent"))
        moving = current.where(F.col("item_id") != F.col("parent"))
        jumped = moving.join(above, "parent", "left").select(
            "item_id", F.coalesce("up", "parent").alias("next"), "parent"
        )
        step = cut_lineage(jumped)
        current = settled.unionByName(step.select("item_id", F.col("next").alias("parent")))
        if step.where(F.col("next") != F.col("parent")).isEmpty():
            return current.select("item_id", F.col("parent").alias("root"))
    raise RuntimeError("parents did not settle: they do not form a forest")


def assign(members: DataFrame, identifiers: DataFrame, stored: DataFrame | None = None,
           merge: float = MERGE, ambiguous: float = AMBIGUOUS, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(item_id, story_id, how, score) of every new item.

    A story is named by its opening item; one that exists keeps its name, which
    ``stored`` (item_id, story_id) tells for the items of batch 0.
    """
    linked = cut_lineage(parents(members, identifiers, merge, ambiguous, window_days))
    rooted = roots(linked)
    if stored is None:
        named = rooted.select("item_id", F.col("root").alias("story_id"))
    else:
        # A root outside the new items is a stored item: its story takes over.
        known = stored.select(F.col("item_id").alias("root"), F.col("story_id").alias("kept"))
        named = rooted.join(known, "root", "left").select("item_id", F.coalesce("kept", "root").alias("story_id"))
    return linked.join(named, "item_id").select("item_id", "story_id", "how", "nearest", "score")


def clocks(assigned: DataFrame, items: DataFrame) -> DataFrame:
    """First seen, last activity and last material update of each story."""
    rows = assigned.join(items.select("item_id", "kind", "at"), "item_id")
    opens = F.col("item_id") == F.col("story_id")
    return rows.groupBy("story_id").agg(
        F.max(F.when(opens, F.col("at"))).alias("first_seen"),
        F.max("at").alias("last_activity"),
        F.max(F.when(opens | F.col("kind").isin(*PRIMARY_KINDS), F.col("at"))).alias("materially_updated"),
    )


def stats(assigned: DataFrame) -> DataFrame:
    sizes = assigned.groupBy("story_id").agg(F.count("*").alias("n"))
    multi = F.col("n") > 1
    return sizes.agg(
        F.count("*").alias("stories"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.count_if(~multi).alias("singletons"), F.count_if(multi).alias("multi"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(F.when(multi, F.col("n"))), F.lit(0)).alias("items_in_multi"),
    )
