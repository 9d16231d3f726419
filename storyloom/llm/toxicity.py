"""Toxicity by a weighted finite-state grammar over clauses.

A text is read as clauses. A word transducer maps words to symbols: insult ``I``,
threat ``T``, target ``U``, negation ``N``, reporting ``R``, quoting ``Q``, anything
else ``.``; a clause grammar, composed on top, reads the symbols and gives the
clause a pattern with a weight. A negated or reported insult weighs less, one
aimed at a target more. Words alone never score; what scores is how often each
clause pattern is matched.

The insult vocabulary is the fixed list below and what labelled texts add:
beginnings of words that stand in toxic texts far more often than in others
(``learn_prefixes``). The weights of the patterns are a logistic fit on matched
clause counts of labelled texts. Both use a bounded sample of labelled rows
(``MAX_ROWS``, ``MAX_BYTES`` per label); scoring takes every whole text.

Only clauses that hold an insult or threat are composed; a text without one, and
so a null or empty text, has no matched clause and scores the base rate of such
texts. Rows are scored one by one, so repeated rows and ids need no care.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import Logistic, bounded_sample, fold, label_rows, one_label, row_weights

MAX_ROWS, MAX_BYTES, THRESHOLD = 4000, 32_000_000, 0.7
#: A beginning is learned when it is this long, in this many toxic texts of the
#: learning half, and at least so many times likelier there.
LEAST_LETTERS, LEAST_TEXTS, LEAST_ODDS = 4, 5, 12.0

# Word lists of the grammar, in English, German, French and Spanish.
INSULTS = (
    "clown", "disgusting", "dumb", "idiot", "idiots", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
    "abschaum", "arschloch", "dummkopf", "trottel", "widerlich", "connard", "imbécile", "ordure", "salaud", "basura", "estúpido", "imbécil",
)
THREATS = ("kill", "hurt", "destroy", "burn", "beat", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGETS = (
    "you", "your", "he", "she", "they", "them", "him", "her", "this", "that", "du", "dich", "ihr", "sie", "er", "tu", "toi", "vous", "il", "elle", "ils", "tú", "usted", "él", "ella", "ellos",
)
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "ni")
REPORTS = ("said", "says", "wrote", "called", "reported", "claimed", "quoted", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "llamó", "escribió")

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")

#: The clause grammar over symbols, first match counts; each is one weighted pattern.
GRAMMAR = tuple((name, re.compile(pattern)) for name, pattern in (
    ("reported", r"R.*Q.*[IT].*Q|R.*[IT]"),
    ("negated", r"N\.{0,3}[IT]"),
    ("threat_at_target", r"T\.{0,4}U|U\.{0,4}T"),
    ("insult_at_target", r"U\.{0,6}I|I\.{0,6}U"),
    ("repeated_insult", r"I.*I"),
    ("insult", r"I"),
    ("threat", r"T"),
))


@dataclass
class Grammar:
    """The composed transducers: learned beginnings, fixed words, clause patterns."""

    prefixes: dict[str, float]

    def __post_init__(self):
        self.symbols = {}
        for symbol, words in (("U", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS), ("I", INSULTS)):
            self.symbols.update(dict.fromkeys(words, symbol))
        for mark in '"“”«»':
            self.symbols[mark] = "Q"
        # One automaton finds whether a text holds any insult or threat at the start of a word.
        fixed = [w + r"(?![^\W\d_])" for w in (*INSULTS, *THREATS)]
        self.alarm = re.compile(r"(?<![^\W\d_])(?:" + "|".join([*map(re.escape, sorted(self.prefixes)), *fixed]) + ")")
        self.lengths = sorted({len(p) for p in self.prefixes})

    def symbol(self, word: str) -> tuple[str, float]:
        """Output symbol and weight of the word transducer."""
        fixed = self.symbols.get(word)
        learned = max((self.prefixes.get(word[:n], 0.0) for n in self.lengths if n <= len(word)), default=0.0)
        if learned > 0:
            return "I", learned
        return (fixed, 1.0) if fixed else (".", 0.0)

    def clauses(self, text: str):
        """(pattern, weight) of every clause that matches."""
        low = text.lower()
        seen = -1
        for hit in self.alarm.finditer(low):
            if hit.start() < seen:
                continue
            begin = max((low.rfind(c, 0, hit.start()) for c in ".!?;:\n"), default=-1) + 1
            end = _CLAUSE.search(low, hit.end())
            seen = end.start() if end else len(low)
            read = [self.symbol(w) for w in _WORD.findall(low, begin, seen)]
            line = "".join(s for s, _ in read)
            for name, pattern in GRAMMAR:
                if pattern.search(line):
                    yield name, max(w for _, w in read)
                    break

    def features(self, text: str | None) -> list[float]:
        """Per pattern the matched clauses (logarithmic), their weight, and their share of the text."""
        text = text or ""
        count, most, weight = Counter(), 0.0, 0.0
        for name, w in self.clauses(text):
            count[name] += 1
            most, weight = max(most, w), weight + w
        total = sum(count.values())
        return [
            *(math.log1p(count[name]) for name, _ in GRAMMAR), most, float(total > 0), math.log1p(total), math.log1p(weight),
            weight / (1 + len(text) / 100),
        ]


def learn_prefixes(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Beginnings (and whole words) of high odds, with their log-odds; of nested ones the shortest that qualifies."""
    counts, totals = (Counter(), Counter()), [0, 0]
    for text, label in rows:
        words = {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) >= LEAST_LETTERS}
        counts[label].update({w[:n] for w in words for n in range(LEAST_LETTERS, min(len(w), 12) + 1)})
        totals[label] += 1
    kept: dict[str, float] = {}
    for word in sorted(counts[1], key=len):
        n = counts[1][word]
        if n < LEAST_TEXTS or any(word[:k] in kept for k in range(LEAST_LETTERS, len(word))):
            continue
        odds = ((n + 0.5) / (totals[1] + 1)) / ((counts[0][word] + 0.5) / (totals[0] + 1))
        if odds >= LEAST_ODDS:
            kept[word] = math.log(odds)
    return kept


@dataclass
class Model:
    grammar: Grammar
    calibrate: Logistic | None
    prior: float

    def score(self, texts) -> np.ndarray:
        if self.calibrate is None or not len(texts):
            return np.full(len(texts), self.prior)
        return self.calibrate(np.array([self.grammar.features(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """``labels`` (doc_id, label). Every second sampled text teaches the vocabulary, the others the weights; there
    a text counts as often as its label has rows for it."""
    rows = bounded_sample(docs, labels, max_rows, max_bytes)
    totals = label_rows(docs, labels)
    prior = totals[1] / sum(totals.values()) if any(totals.values()) else 0.0
    if len({y for _, y in rows}) < 2:
        return Model(Grammar({}), None, min(prior, 0.5))
    grammar = Grammar(learn_prefixes(rows[::2]))
    held = rows[1::2]
    weights = row_weights(rows, totals)
    fitted = Logistic(np.array([grammar.features(t) for t, _ in held]), np.array([y for _, y in held]), np.array([weights[y] for _, y in held]))
    return Model(grammar, fitted, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; all columns stay, one named score is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts))

    return docs.withColumn("score", rate(F.col("text")))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    learning = one_label(labels, "toxic").where(fold(F.col("doc_id"), 3) != 1)
    scored = score(docs.select("doc_id", "text"), fit(docs, learning))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
