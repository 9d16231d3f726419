"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression and the Boolean trigram query that any match
of it must satisfy: alternatives of sets of trigrams, all of one set present in
the lower-cased text. ``postings`` maps the trigrams the queries name to
documents, ``candidates`` intersects the postings of a set and unites the sets,
and only candidates are verified with the expression. A rule whose expression
forces no literal of three characters (``hex``) is checked on every text.

Spans are code points, end exclusive, leftmost and non-overlapping per rule.
The base rules are ``assign``, ``access`` and ``hex``; the others add spans.
Null text is empty; texts without a finding give empty strings and zero counts.
Rows with equal (doc_id, text) are found and reported once each; documents of
one id and different texts are kept apart by the text's hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import stored


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Alternatives; each lists literals that every match of it holds, lower case.
    literals: tuple[tuple[str, ...], ...]
    #: The group whose length is tested, and the least length.
    group: int = 0
    least: int = 1


# The base rules, then well-known token forms.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, (("password",), ("passwd",), ("secret",), ("token",), ("apikey",), ("api_key",)), 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", (("akia",),), 0, 16),
    # A maximal run of 32 or more: the same matches as every run with the short ones dropped.
    Rule("hex", r"[0-9a-f]{32,}", ()),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", (("-----begin ", "private key-----"),)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", (("ghp_",), ("gho_",), ("ghu_",), ("ghs_",), ("ghr_",))),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", (("xoxa-",), ("xoxb-",), ("xoxp-",), ("xoxr-",), ("xoxs-",))),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", (("eyj", ".eyj"),)),
)
BASE = ("assign", "access", "hex")


def trigrams(literal: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(literal[i:i + 3] for i in range(len(literal) - 2)))


def trigram_query(rule: Rule) -> tuple[tuple[str, ...], ...]:
    """Alternatives of trigrams that must all occur; empty where the rule forces none."""
    return tuple(tuple(dict.fromkeys(t for word in words for t in trigrams(word))) for words in rule.literals)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id, text_key): where each trigram that some query names occurs."""
    named = sorted({t for rule in rules for one in trigram_query(rule) for t in one})
    low = docs.select("doc_id", "text_key", F.lower("text").alias("low"))
    present = F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in named])
    return low.select(F.explode(F.array_compact(present)).alias("trigram"), "doc_id", "text_key")


def candidates(posted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_key, kinds): the rules whose query a document's postings satisfy."""
    # Every alternative is a set of trigrams: a document counts for it when all its postings are there.
    sets = [(rule.kind, one) for rule in rules for one in trigram_query(rule)]
    have = posted.groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("have"))
    met = [F.when(F.size(F.array_intersect("have", F.array(*map(F.lit, one)))) == len(one), F.lit(kind)) for kind, one in sets]
    return have.select("doc_id", "text_key", F.array_distinct(F.array_compact(F.array(*met))).alias("kinds")).where(F.size("kinds") > 0)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, stop, kind>> of the rule's matches that pass its length test."""
    pattern = F.lit(rule.pattern)
    # Texts between matches and the matches themselves give all places by their lengths.
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.arrays_zip(
        F.transform(gaps, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("width"),
        F.transform(tested, F.char_length).alias("tested"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint,tested:int>>").alias("out"))
    walked = F.aggregate(
        F.filter(steps, lambda s: s["width"].isNotNull()), start,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["width"]).alias("at"),
            F.when(
                s["tested"] >= rule.least,
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["width"]).alias("stop"), s["tested"].alias("tested"),
                ))),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.transform(walked["out"], lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))


NO_SPANS = "array<struct<start:bigint,stop:bigint,kind:string>>"


def _found(docs: DataFrame, rules: list[Rule], wanted: Column | None) -> DataFrame:
    """(doc_id, text_key, found) of the documents in which one of ``rules`` matches."""
    tests = []
    for rule in rules:
        maybe = F.col("text").rlike(rule.pattern)
        due = maybe if wanted is None else F.array_contains(wanted, rule.kind) & maybe
        tests.append(F.when(due, spans(F.col("text"), rule)).otherwise(F.array().cast(NO_SPANS)))
    return docs.select("doc_id", "text_key", F.flatten(F.array(*tests)).alias("found")).where(F.size("found") > 0)


def _matched(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``docs`` beside the row of ``side`` for the same (doc_id, text_key); null ids meet null ids."""
    other = side.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), how).drop("_id", "_key")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_key, found): one row per distinct (doc_id, text) that holds a finding."""
    own = _keyed(docs)
    indexed, free = [r for r in rules if trigram_query(r)], [r for r in rules if not trigram_query(r)]
    parts = []
    if indexed:
        # The candidates are written: they tell their size, and Spark sends them to the texts only if they are few.
        chosen = stored(candidates(postings(own, rules), rules), "secret-candidates")
        parts.append(_found(_matched(own, chosen, "inner"), indexed, F.col("kinds")))
    if free:
        parts.append(_found(own, free, None))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.dropDuplicates().groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("found")).alias("found"))


def joined(found: Column, kinds: tuple[str, ...], rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans of ``kinds``, by start, then kind as listed, comma-joined."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    keyed = F.transform(
        F.filter(found, lambda s: s["kind"].isin(*kinds)),
        lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    found = F.coalesce("found", F.array().cast(NO_SPANS))
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    rows = _matched(_keyed(docs).select("doc_id", "text_key"), scan(docs, rules), "left")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(found, BASE, rules).cast("binary"), 256).alias("base_sha256"),
        joined(found, tuple(r.kind for r in rules), rules).alias("spans"),
    )
