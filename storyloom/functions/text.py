"""Plain-text columns: flattening, cutting, slugs and short names."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A tag, a run of blanks, blanks before closing and after opening punctuation.
TAG = r"<[^>]+>"
BLANK = r"(?U)\s+"
SPACE_BEFORE = r"(?U)\s+([,.;:!?)\]}])"
SPACE_AFTER = r"(?U)([(\[{])\s+"
# Every character counted as white space at the ends of a text.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


@F.arrow_udf(T.StringType())
def _entities(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


def decode_entities(text: Column) -> Column:
    """Named and numeric HTML entities; only text holding ``&`` leaves the JVM."""
    return F.coalesce(_entities(F.when(F.contains(text, F.lit("&")), text)), text)


def decode_each(texts: Column) -> Column:
    """``decode_entities`` of every element of an array; the texts leave the JVM as one."""
    mark = "\x01"  # no text of a page or feed holds this control
    joined = decode_entities(F.array_join(texts, mark))
    return F.when(F.size(texts) > 0, F.split(joined, mark)).otherwise(texts)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used.

    Expressions under CASE branches are not shared by code generation, so a
    costly one named several times would run several times.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def none_if_blank(text: Column) -> Column:
    return bind(text, lambda t: F.when(t != "", t))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, BLANK, " "))


def strip_html(text: Column) -> Column:
    """An HTML fragment as plain text, NULL when nothing is left."""
    flat = F.regexp_replace(decode_entities(F.regexp_replace(text, TAG, " ")), BLANK, " ")
    flat = F.regexp_replace(flat, SPACE_BEFORE, "$1")
    flat = F.regexp_replace(flat, SPACE_AFTER, "$1")
    return none_if_blank(F.btrim(flat))


# The boilerplate two feed services write into descriptions.
PREPRINT_PREFIX = r"(?i)^\s*arxiv:\s*\S+\s*(?:announce\s+type:\s*\w+)?\s*(?:abstract:)?\s*"
LINK_METADATA = r"(?i)article url:\s*\S+|comments url:\s*\S+|points:\s*\d+|#\s*comments:\s*\d+"


def strip_boilerplate(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, PREPRINT_PREFIX, ""), LINK_METADATA, "")
    return none_if_blank(squeeze(cleaned))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut back to a late enough word boundary."""

    def shortened(head: Column) -> Column:
        after_space = F.instr(F.reverse(head), " ")
        last_space = F.when(after_space > 0, F.lit(limit) - after_space).otherwise(F.lit(-1))
        cut = F.when(last_space > 0.6 * limit, head.substr(F.lit(1), last_space)).otherwise(head)
        return F.concat(F.rtrim(cut, F.lit(SPACES)), F.lit("…"))

    return bind(text, lambda t: F.when(F.length(t) <= limit, t).otherwise(bind(F.substring(t, 1, limit), shortened)))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    cut = F.substring(F.btrim(dashed, F.lit("-")), 1, 60)
    return F.when(cut == "", F.lit("topic")).otherwise(cut)


def short_name(title: Column) -> Column:
    """A headline up to its first colon or dash, at most six words."""
    head = F.split(title, r":\s| [–—-] ", 2)[0]
    words = F.filter(F.split(head, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 6), " ")


# The small words a topic's name is not searched for.
SMALL_WORDS = (
    "the", "and", "of", "in", "on", "to", "for", "an", "a", "at",
    "by", "or", "news", "och", "i", "på", "av", "om", "en", "ett",
    "med", "för",
)


def words(text: Column) -> Column:
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(*SMALL_WORDS))


def quoted(word: Column) -> Column:
    """A word made literal for a Java regex."""
    return F.regexp_replace(word, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def mentions(text: Column, word: Column) -> Column:
    """A whole word or its plural, in already lower-case text."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted(word), F.lit(r"(s|es)?(?![\p{L}\p{N}])"))
    return F.regexp_like(text, pattern)


def names_all(text: Column, name: Column) -> Column:
    """Every word of ``name`` is mentioned; a name without words mentions nothing."""
    asked = words(name)
    lowered = F.lower(text)
    return (F.size(asked) > 0) & F.forall(asked, lambda w: mentions(lowered, w))


def ago_label(hours: Column) -> Column:
    return (
        F.when(hours.isNull(), F.lit(""))
        .when(hours < 1, F.lit("now"))
        .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))
    )


# The order and wording of a card's "there is more" line.
SIGNAL_LABELS = (
    ("paper", "paper"), ("code", "repo"), ("video", "video"),
    ("discussion", "discussion"), ("coverage", "article"),
)


def signal(role_counts: dict[str, Column], sources: Column) -> Column:
    parts = []
    for role, label in SIGNAL_LABELS:
        n = role_counts[role]
        many = F.when(n > 1, F.lit(label + "s")).otherwise(F.lit(label))
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), many)))
    parts.append(F.when(sources > 1, F.concat(sources.cast("string"), F.lit(" sources"))))
    return F.concat_ws(" · ", *parts)


# Openings of a markdown block that is not prose, and stock phrases.
NOT_PROSE_OPENINGS = ("#", "|", ">", "-", "*", "+", "```", "<", "[!", ":")
CARD_PHRASES = (
    "more information needed",
    "this model card has been automatically generated",
    "model card of a",
    "should be made aware of the risks",
    "use the code below to get started",
    "carbon emissions can be estimated",
    "[optional]",
    "more details on the model",
    "direct use",
)
PROSE_MINIMUM, WRITTEN_MINIMUM = 40, 18


_OPENING = "^(?:" + "|".join(re.escape(m) for m in NOT_PROSE_OPENINGS) + ")"
_STOCK = "(?i)" + "|".join(re.escape(p).replace("\\ ", " ") for p in CARD_PHRASES)


def _bare_block(block: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(block, r"\[([^\]]*)\]\([^)]*\)", "$1"), "\n", " ")
    return F.regexp_replace(flat, TAG, " ")


def _flat_block(block: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(block, BLANK, " "), SPACE_BEFORE, "$1")
    return F.btrim(F.regexp_replace(flat, SPACE_AFTER, "$1"))


def prose_summary(markdown: Column) -> Column:
    """The first block of real prose in a markdown document, whole.

    What kind of block it is shows in the text as written; entities are decoded
    after that, for all blocks at once. Every step over the blocks is a pass of
    its own, so no block is worked on twice.
    """
    body = F.regexp_replace(markdown, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    bare = F.transform(F.split(body, "\n\n"), lambda b: strip(F.regexp_replace(b, r"!\[[^\]]*\]\([^)]*\)", "")))
    written = F.filter(bare, lambda b: (b != "") & ~F.regexp_like(b, F.lit(_OPENING)))
    flat = F.transform(decode_each(F.transform(written, _bare_block)), _flat_block)
    prose = F.filter(flat, lambda b: (F.length(b) > PROSE_MINIMUM) & ~F.regexp_like(b, F.lit(_STOCK)))
    return F.get(prose, F.lit(0))
