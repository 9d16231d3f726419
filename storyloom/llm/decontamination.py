"""Benchmark decontamination by templates.

Words become a template: numbers, units and names turn into typed placeholders,
other words into their lower-case core. Windows of ``WINDOW`` words are hashed
under two keys: the template, when at least half of its words are literal, and
the lower-case words themselves, whatever their place and case. Documents and
items meet in a join on the keys; what met is then compared word by word.

Two words agree when their templates or their lower-case cores are equal. A run of
agreeing words that holds a window of equal key counts when its slots agree: the
same value in the item stands opposite the same value in the document all along,
so a question with other numbers is caught and a text that merely shares the shape
is not. A run of equal words counts without that. A document is contaminated by an
item when a run covers ``LEAST_RUN`` words, or ``LEAST_SHARE`` of a shorter item.
An item of ``WINDOW`` words or fewer is one window, found as a whole; documents are
read at every width that occurs among the items. Words with hardly a literal among
them are found verbatim only, or next to a window that met.

A name is a capitalised word, not one all in capitals, that is no ``COMMON`` word; its place does not matter, so a
name that opens a sentence is one too. Words that may be either, such as Will, count as names. Before the join, window
hashes of documents pass a bitmap of fixed size made from all items; it only saves
work, every hit is decided by the join. Items may be many: nothing of them is
collected but the bitmap and the widths.

Null or empty texts and items match nothing. Repeated rows give one result; one id
with two texts is contaminated when either is.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import stored, unused

WINDOW, LEAST_RUN, LEAST_SHARE = 8, 13, 0.8
BITMAP_WORDS = 1 << 16  # 64 bits each
VERBATIM = 1 << 32  # seed of the keys of plain words
#: Words a worker remembers before it starts anew, and texts whose words are learned together.
MEMO, AT_ONCE = 400_000, 256

# Unit words, in lower case, and number words.
UNITS = frozenset((
    "mm", "cm", "km", "m", "ft", "inch", "inches", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers",
    "mg", "g", "kg", "lb", "lbs", "oz", "pound", "pounds", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonnes", "ml", "l", "liter", "liters", "litre", "litres",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "mph", "kmh", "km/h", "m/s", "hz", "khz", "mhz", "kb", "mb", "gb", "tb", "dollar", "dollars", "usd", "euro", "euros", "eur", "cent", "cents", "percent",
    "degrees", "celsius", "fahrenheit", "volt", "volts", "watt", "watts", "joule", "joules", "newton", "newtons",
))
NUMBER_WORDS = frozenset((
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million", "billion",
))
# Function words and words that open questions and tasks: never names, capitalised or not. Words that also serve as names (will, may, mark) are left out.
COMMON = frozenset((
    "a", "an", "the", "this", "that", "these", "those", "there", "here", "it", "its", "he", "she", "his", "her", "hers", "him", "they", "them", "their", "we", "us", "our", "you", "your", "i", "my", "me",
    "who", "whom", "whose", "what", "which", "when", "where", "why", "how", "whether", "if", "then", "else", "because", "since", "although", "though", "while", "until", "unless", "as", "so", "than",
    "and", "or", "but", "nor", "not", "no", "yes", "none", "neither", "either", "both", "each", "every", "all", "any", "some", "many", "much", "most", "more", "few", "several", "such", "other", "another",
    "of", "in", "on", "at", "by", "for", "from", "to", "with", "without", "about", "after", "before", "during", "between", "among", "through", "over", "under", "above", "below", "into", "onto", "near", "per",
    "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "has", "have", "had", "can", "could", "would", "should", "shall", "must", "might", "let", "suppose", "assume", "given", "consider",
    "find", "calculate", "compute", "determine", "solve", "show", "prove", "write", "explain", "describe", "choose", "select", "list", "give", "state", "name", "answer", "question", "read", "use", "complete",
    "now", "today", "tomorrow", "yesterday", "later", "first", "second", "next", "last", "finally", "however", "therefore", "thus", "hence", "also", "only", "just", "still", "once", "again", "together", "altogether", "please", "note",
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines", "und", "oder", "aber", "nicht", "ist", "sind", "war", "waren", "hat", "haben", "wird", "werden", "er", "sie", "es", "wir", "ihr",
    "wer", "was", "wie", "wo", "wann", "warum", "welche", "welcher", "welches", "wenn", "als", "auf", "aus", "bei", "mit", "nach", "von", "vor", "zu", "zum", "zur", "im", "für", "über", "unter", "durch", "auch", "nur", "dann", "sich",
    "le", "la", "les", "un", "une", "du", "de", "et", "ou", "mais", "ne", "pas", "est", "sont", "il", "elle", "ils", "elles", "nous", "vous", "ce", "cette", "ces", "qui", "que", "quoi", "quel", "quelle", "où", "quand", "comment",
    "pourquoi", "si", "dans", "sur", "sous", "avec", "pour", "par", "sans", "entre", "aux", "au", "el", "los", "las", "una", "unos", "unas", "y", "o", "pero", "no", "es", "son", "él", "ella", "ellos", "en", "con", "por", "para", "sin",
    "qué", "quién", "cuál", "cómo", "cuándo", "dónde", "cuánto", "cuántos", "al", "del", "se", "su",
))
EMPTY, LITERAL, NUMBER, UNIT, MEASURE = range(5)
NAME = 5
_PLACE = np.array([0, 0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_MEASURE = re.compile(r"[+-]?\d[\d.,]*(?:%s)" % "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True)))
_EDGE = re.compile(r"^\W+|\W+$")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


class Templates:
    """Template words of texts; what a word is by itself is remembered."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = None

    @staticmethod
    def _read(word: str) -> tuple:
        """(hash of the core, kind)."""
        core = word if word.isalpha() else _EDGE.sub("", word)
        if not core:
            return 0, EMPTY
        low = core.lower()
        kind = LITERAL
        if low in UNITS:
            kind = UNIT
        elif low in NUMBER_WORDS:
            kind = NUMBER
        elif not core.isalpha():
            if _NUMBER.fullmatch(word.strip("()[]\"'“”«».,;:!?")):
                kind = NUMBER
            elif _MEASURE.fullmatch(low):
                kind = MEASURE
        if kind == LITERAL and core[0].isupper() and not core.isupper() and low not in COMMON:
            kind = NAME
        return _hash(low), kind

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known from now on."""
        words = [(text or "").split() for text in texts]
        if len(self.known) > MEMO:
            self._forget()
        fresh = list(set().union(*words).difference(self.known))
        if fresh:
            rows = list(zip(*map(self._read, fresh)))
            new = tuple(np.array(column, kind) for column, kind in zip(rows, (np.uint64, np.int8)))
            self.table = new if self.table is None else tuple(np.concatenate(p) for p in zip(self.table, new))
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        return words

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template hash, value hash, kind, row) per word that is not only punctuation, text after text."""
        words = self.learn(texts)
        flat = list(chain.from_iterable(words))
        if not flat:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        value, kind = (column[at] for column in self.table)
        keep = kind != EMPTY
        value, kind = value[keep], kind[keep]
        return np.where(kind == LITERAL, value, _PLACE[kind]), value, kind, row[keep]

    def __call__(self, texts: list[str | None]):
        """(first text, ``read``) of ``AT_ONCE`` texts at a time."""
        for k in range(0, len(texts), AT_ONCE):
            yield k, self.read(texts[k:k + AT_ONCE])


_TEMPLATES = Templates()


def _hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    n = len(words) - width + 1
    out = np.full(n, np.uint64(seed + width), np.uint64)
    for k in range(width):
        out ^= words[k:k + n]
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def _full(flags: np.ndarray, width: int) -> np.ndarray:
    """How many of each ``width`` neighbours are set."""
    count = np.append(0, np.cumsum(flags))
    return count[width:] - count[:len(count) - width]


def windows(template: np.ndarray, value: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template key, verbatim key, light) of every window; light when half its words or more are literal."""
    return _hashes(template, width, 0), _hashes(value, width, VERBATIM), _full(kind == LITERAL, width) * 2 >= width


_SCHEMA = "h long, key_id long, key_text long, at int, n_words int"


def _window_rows(rows: DataFrame, widths=None, bitmap=None) -> DataFrame:
    """``rows`` (key_id, key_text, text) as window rows: items in windows of ``WINDOW`` words or as one
    shorter window, documents in windows of all ``widths``, as far as the bitmap lets them pass."""

    def read(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)

        def passed(keys):
            if bits is None:
                return np.ones(len(keys), bool)
            return (bits[(keys >> np.uint64(6)) % np.uint64(BITMAP_WORDS)] >> (keys & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            for k, (template, value, kind, row) in _TEMPLATES(batch.column("text").to_pylist()):
                sizes = np.bincount(row)
                first = np.cumsum(sizes) - sizes
                own_width = np.minimum(sizes, WINDOW)
                for width in (np.unique(own_width).tolist() if widths is None else widths):
                    if not 0 < width <= len(row):
                        continue
                    by_template, verbatim, light = windows(template, value, kind, width)
                    n = len(light)
                    inside = row[:n] == row[width - 1:]
                    if widths is None:
                        inside &= own_width[row[:n]] == width
                    light = np.flatnonzero(inside & light & passed(by_template))
                    plain = np.flatnonzero(inside & passed(verbatim))
                    if width < WINDOW:  # one window is the whole item: equal ones of a text decide alike
                        light, plain = (at[_firsts(row[at], by_template[at], verbatim[at])] for at in (light, plain))
                    at = np.append(light, plain)
                    own = row[at]
                    from_row = pa.array(own + k)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.append(by_template[light], verbatim[plain]).view(np.int64)), batch.column("key_id").take(from_row),
                        batch.column("key_text").take(from_row), pa.array((at - first[own]).astype(np.int32)), pa.array(sizes[own].astype(np.int32)),
                    ], ["h", "key_id", "key_text", "at", "n_words"])

    return rows.mapInArrow(read, _SCHEMA)


def _firsts(row: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the first of each equal (row, keys)."""
    return np.unique(np.column_stack([row.astype(np.uint64), *keys]), axis=0, return_index=True)[1]


_WORDS = "template binary, value binary, kind binary"


def _item_words(rows: DataFrame) -> DataFrame:
    """(item_id, item_text, item_template, item_value, item_kind): the words of each item."""

    def read(batches):
        for batch in batches:
            columns = [[], [], []]
            for text in batch.column("text").to_pylist():
                for own, words in zip(columns, _TEMPLATES.read([text])):
                    own.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key_id"), batch.column("key_text"), *(pa.array(c, pa.binary()) for c in columns)],
                                             ["item_id", "item_text", "item_template", "item_value", "item_kind"])

    return rows.dropDuplicates(["key_id", "key_text"]).mapInArrow(read, "item_id long, item_text long, item_template binary, item_value binary, item_kind binary")


def _stretches(rows: DataFrame) -> DataFrame:
    """``rows`` (key_id, key_text, text, met): per met item and diagonal the document's words opposite the item."""

    def read(batches):
        for batch in batches:
            for at, (key, text_key, text, met) in enumerate(zip(*(batch.column(name).to_pylist() for name in ("key_id", "key_text", "text", "met")))):
                template, value, kind, _ = _TEMPLATES.read([text])
                for k in range(0, len(met), AT_ONCE):
                    part = met[k:k + AT_ONCE]
                    cut = [slice(max(0, m["diagonal"]), max(0, m["diagonal"] + m["n_words"])) for m in part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(part), pa.int64()), pa.array([text_key] * len(part), pa.int64()),
                        pa.array([m["item_id"] for m in part], pa.int64()), pa.array([m["item_text"] for m in part], pa.int64()),
                        pa.array([max(0, -m["diagonal"]) for m in part], pa.int32()),
                        *(pa.array([words[c].tobytes() for c in cut], pa.binary()) for words in (template, value, kind)),
                    ], ["key_id", "key_text", "item_id", "item_text", "skipped", "template", "value", "kind"])

    return rows.mapInArrow(read, f"key_id long, key_text long, item_id long, item_text long, skipped int, {_WORDS}")


def longest_run(item: tuple, text: tuple, n_words: int) -> int:
    """The longest run that counts between the (template, value, kind) of an item of ``n_words`` and of the words opposite; 0 for none."""
    (t, v, k), (other_t, other_v, other_k) = item, text
    width, need = min(WINDOW, n_words), min(LEAST_RUN, math.ceil(n_words * LEAST_SHARE))
    if len(t) < width:
        return 0
    equal, alike = v == other_v, t == other_t
    keyed = (_full(equal, width) == width) | ((_full(alike, width) == width) & (_full(k == LITERAL, width) * 2 >= width))
    best = 0
    for flags in (equal, equal | alike):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin < max(need, width, best + 1) or not keyed[begin:end - width + 1].any():
                continue
            if flags is not equal:
                slots = np.flatnonzero((k[begin:end] != LITERAL) | (other_k[begin:end] != LITERAL)) + begin
                pairs = set(zip(v[slots].tolist(), other_v[slots].tolist()))
                if len(pairs) != len({a for a, _ in pairs}):
                    continue
            best = end - begin
    return best


def _judged(rows: DataFrame) -> DataFrame:
    """(key_id, key_text, item_id, run_words, item_words) of the stretches whose run counts."""

    def read(batches):
        for batch in batches:
            names = ("skipped", "template", "value", "kind", "item_template", "item_value", "item_kind")
            runs, sizes = [], []
            for skipped, *words in zip(*(batch.column(name).to_pylist() for name in names)):
                read_as = [np.frombuffer(w, kind) for w, kind in zip(words, (np.uint64, np.uint64, np.int8) * 2)]
                n_words, n = len(read_as[3]), len(read_as[0])
                runs.append(longest_run(tuple(w[skipped:skipped + n] for w in read_as[3:]), tuple(read_as[:3]), n_words))
                sizes.append(n_words)
            out = pa.RecordBatch.from_arrays([*(batch.column(name) for name in ("key_id", "key_text", "item_id")), pa.array(runs, pa.int32()), pa.array(sizes, pa.int32())],
                                             ["key_id", "key_text", "item_id", "run_words", "item_words"])
            yield out.filter(pa.array([run > 0 for run in runs], pa.bool_()))

    return rows.mapInArrow(read, "key_id long, key_text long, item_id long, run_words int, item_words int")


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("key_id"), F.xxhash64("text").alias("key_text"), "text").where(F.col("text").isNotNull())


def _bitmap(hashes: DataFrame) -> bytes:
    """The fixed-size bitmap of all window hashes, one row per word that has a bit."""
    word = F.pmod(F.shiftrightunsigned("h", 6), F.lit(BITMAP_WORDS))
    rows = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).collect()
    bits = np.zeros(BITMAP_WORDS, np.int64)
    for r in rows:
        bits[r["word"]] = r["bits"]
    return bits.tobytes()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, run_words, item_words): the longest consistent run of each pair that counts."""
    spark = docs.sparkSession
    items, texts = _keyed(benchmark, "item_id"), _keyed(docs, "doc_id")
    own = stored(_window_rows(items), "benchmark-windows")
    words = stored(_item_words(items), "benchmark-words")
    bitmap = spark.sparkContext.broadcast(_bitmap(own.select("h")))
    widths = [r.width for r in own.select(F.least("n_words", F.lit(WINDOW)).alias("width")).distinct().collect()]
    other = own.select("h", F.col("key_id").alias("item_id"), F.col("key_text").alias("item_text"), F.col("at").alias("item_at"), F.col("n_words").alias("item_words"))
    met = _window_rows(texts, widths, bitmap).join(other, "h").select(
        F.col("key_id").alias("met_id"), F.col("key_text").alias("met_text"),
        F.struct("item_id", "item_text", F.col("item_words").alias("n_words"), (F.col("at") - F.col("item_at")).alias("diagonal")).alias("met"),
    )
    met = stored(met.groupBy("met_id", "met_text").agg(F.collect_set("met").alias("met")), "benchmark-met")
    found = _stretches(texts.join(met, F.col("key_id").eqNullSafe(F.col("met_id")) & (F.col("key_text") == F.col("met_text"))).select("key_id", "key_text", "text", "met"))
    words = words.withColumnsRenamed({"item_id": "word_id", "item_text": "word_text"})
    runs = _judged(found.join(words, F.col("item_id").eqNullSafe(F.col("word_id")) & (F.col("item_text") == F.col("word_text"))))
    return runs.groupBy(
        F.col("key_id").alias("doc_id"), F.col("key_text").alias("text_key"), "item_id",
    ).agg(F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document: the items found in it and the longest run."""
    return matches(docs, benchmark).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("run_words").cast("long").alias("longest_run"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents no item contaminates, columns as they came."""
    one, key = unused(docs.columns, "found_id"), unused(docs.columns, "found_key")
    found = stored(matches(docs, benchmark).select(F.col("doc_id").alias(one), F.col("text_key").alias(key)).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(key)), "left_anti")
