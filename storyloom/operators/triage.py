"""Relevance scoring against a prose profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.scoring import with_best

THRESHOLD, EXPLAINED = 0.62, 5


def first_keyword(title: Column, keywords: list[str]) -> Column:
    """The first keyword of the list the title holds, else NULL."""
    lowered = F.lower(title)
    return F.coalesce(F.lit(None).cast("string"), *[F.when(F.contains(lowered, F.lit(k)), F.lit(k)) for k in keywords])


def decision(title: Column, score: Column, exclude: Column, threshold: float, keep: list[str], drop: list[str]) -> Column:
    """(state, reason): keywords first, then exclusion, then the threshold."""
    said = lambda state, reason: F.struct(F.lit(state).alias("state"), reason.alias("reason"))
    dropped, wanted = first_keyword(title, drop), first_keyword(title, keep)
    text = lambda c: F.format_string("%.3f", c)
    return (
        F.when(dropped.isNotNull(), said("rejected", F.concat(F.lit("always_drop: "), dropped)))
        .when(wanted.isNotNull(), said("kept", F.concat(F.lit("always_keep: "), wanted)))
        .when(exclude > score, said("rejected", F.concat(F.lit("closer to excluded ("), text(exclude), F.lit(")"))))
        .when(score >= threshold, said("kept", F.concat(F.lit("similarity "), text(score))))
        .otherwise(said("rejected", F.concat(F.lit("below threshold ("), text(score), F.lit(")"))))
    )


def score(vectors: DataFrame, interests: DataFrame, excludes: DataFrame, explained: int = EXPLAINED) -> DataFrame:
    """Best interest, best exclude and the ``explained`` best interests per vector; references are (key, vector).

    Without excludes the exclude score is 0, which still outvotes a negative one.
    """
    rows = with_best(vectors.select("item_id", "embedding"), "item_id", "embedding", interests, explained, "interests")
    rows = with_best(rows, "item_id", "embedding", excludes, 1, "against")
    best = F.get("interests", F.lit(0))
    return rows.select("item_id", best["score"].alias("score"), best["key"].alias("best"),
                       F.coalesce(F.get("against", F.lit(0))["score"], F.lit(0.0)).alias("exclude_score"), "interests")


def totals(items: DataFrame, decided: DataFrame) -> DataFrame:
    """Kept and rejected of this run, and pending items still without a vector."""
    waiting = items.where(F.col("triage_state") == "pending").join(decided, "item_id", "left_anti")
    return (
        decided.groupBy(F.col("state").alias("outcome")).agg(F.count("*").alias("n"))
        .unionByName(waiting.agg(F.count("*").alias("n")).select(F.lit("skipped").alias("outcome"), "n"))
    )


def stats(items: DataFrame) -> DataFrame:
    return items.groupBy("triage_state").agg(F.count("*").alias("n"))


def by_source(items: DataFrame) -> DataFrame:
    """How much of each source is kept, for scored items."""
    kept = F.count_if(F.col("triage_state") == "kept")
    return items.where("triage_score IS NOT NULL").groupBy("source").agg(
        F.count("*").alias("total"), kept.alias("kept"), F.avg("triage_score").alias("mean_score"),
        (kept / F.count("*")).alias("rate"),
    )


def margin_sample(items: DataFrame, limit: int = 20) -> DataFrame:
    """The weakest kept and the strongest rejected items.

    Two top-N reads, each cut on every task before anything is gathered, in
    place of a window that would sort one state in one task.
    """
    scored = items.where("triage_score IS NOT NULL").select("item_id", "triage_state", "triage_score")
    weakest = scored.where("triage_state = 'kept'").orderBy("triage_score", "item_id").limit(limit)
    strongest = scored.where("triage_state = 'rejected'").orderBy(F.desc("triage_score"), "item_id").limit(limit)
    return weakest.unionByName(strongest)


def best_of(scores: DataFrame, n: int = EXPLAINED) -> DataFrame:
    """The n best-matching interests of every item, one row each."""
    each = scores.select("item_id", F.posexplode(F.slice("interests", 1, n)).alias("place", "hit"))
    return each.select("item_id", (F.col("place") + 1).alias("place"), F.col("hit.key").alias("interest"),
                       F.col("hit.score").alias("score"))
