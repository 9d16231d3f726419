"""The topic tree: closure, paths, inherited settings, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import cut_lineage


def closure(spine: DataFrame) -> DataFrame:
    """(slug, ancestor, distance) with every topic its own ancestor at 0.

    Ways are doubled: with all up to length n known, those of length n are carried
    on by all others, so a chain takes as many rounds as its length has bits. Each
    round is written. A topic has one parent, so what a cycle meets again is met at
    a greater distance: the smallest counts, and no way is longer than the topics are many.
    """
    rows = spine.select("slug", "parent")
    own = rows.select("slug", F.col("slug").alias("ancestor"), F.lit(0).alias("distance"))
    up = rows.where("parent IS NOT NULL").join(rows.select(F.col("slug").alias("parent")), "parent")
    ways = cut_lineage(own.unionByName(up.select("slug", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))))
    length = 1
    while True:
        size = ways.agg(F.count_if(F.col("distance") == 0).alias("topics"), F.count_if(F.col("distance") == length).alias("longest")).first()
        if length >= size.topics or not size.longest:
            return ways
        longest = ways.where(F.col("distance") == length).select("slug", F.col("ancestor").alias("middle"))
        onward = ways.where("distance > 0").select(F.col("slug").alias("middle"), "ancestor", (F.col("distance") + length).cast("int").alias("distance"))
        further = longest.join(onward, "middle").select("slug", "ancestor", "distance")
        ways, length = cut_lineage(ways.unionByName(further).groupBy("slug", "ancestor").agg(F.min("distance").alias("distance"))), 2 * length


def paths(tree: DataFrame) -> DataFrame:
    """Per topic everything above it, the top first."""
    above = F.sort_array(F.collect_list(F.struct(F.col("distance"), F.col("ancestor"))), asc=False)
    chain = F.transform(F.filter(above, lambda a: a["distance"] > 0), lambda a: a["ancestor"])
    return tree.groupBy("slug").agg(chain.alias("path"))


def leaves(spine: DataFrame) -> DataFrame:
    """Topics nothing sits under."""
    shelves = spine.where("parent IS NOT NULL").select(F.col("parent").alias("slug"))
    return spine.join(shelves, "slug", "left_anti")


def categories(spine: DataFrame) -> DataFrame:
    """Topics at the top that have something under them."""
    shelves = spine.where("parent IS NOT NULL").select(F.col("parent").alias("slug"))
    return spine.where("parent IS NULL").join(shelves, "slug", "left_semi")


def inherited(spine: DataFrame, tree: DataFrame, settings: dict[str, int | None]) -> DataFrame:
    """Each setting from the nearest topic at or above that gives one, else the default."""
    given = tree.join(spine.select(F.col("slug").alias("ancestor"), *settings), "ancestor")
    picks = []
    for name, default in settings.items():
        nearest = F.min_by(name, F.when(F.col(name).isNotNull(), F.col("distance")))
        picks.append(F.coalesce(nearest, F.lit(default)).alias(name))
    return given.groupBy("slug").agg(*picks)


def listing(spine: DataFrame) -> DataFrame:
    """Every topic with its shelf; shelves carry their description."""
    names = spine.select(F.col("slug").alias("parent"), F.col("name").alias("parent_name"))
    shelves = spine.where("parent IS NOT NULL").select(F.col("parent").alias("slug")).distinct().withColumn("is_shelf", F.lit(True))
    return spine.join(names, "parent", "left").join(shelves, "slug", "left").select(
        "slug", "name", "parent", "parent_name", F.when(F.col("is_shelf"), F.col("description")).alias("description")
    )


def children(spine: DataFrame) -> DataFrame:
    """Categories with the topics under them, in spine order."""
    under = spine.where("parent IS NOT NULL").groupBy(F.col("parent").alias("slug")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("slug").alias("child")))), lambda c: c["child"]).alias("children")
    )
    return spine.where("parent IS NULL").join(under, "slug", "left").select("slug", "name", "children")
