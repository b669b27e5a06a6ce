"""Scalar text functions as columns. Offsets count code points, from 0, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is one token, one number, and one digit separator.
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"
NUMBER = r"(?U)\d+(?:[.,/]\d+)*"
_SEPARATED = "(?U)(?<=\\d)[\u00a0\u202f\u2009\u2007](?=\\d)"
#: Typographic characters and what they are read as, place by place.
TYPOGRAPHIC = (
    "\u2010\u2011\u2012\u2013\u2014" "\u2018\u2019\u201a\u2032" "\u201c\u201d" "\u00a0\u202f\u2009\u2007\u2005",
    "-----" "''''" '""' "     ",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words, with a decimal part kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_list(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def fold_typography(text: Column) -> Column:
    """Typographic dashes, quotes and blanks as ASCII; no character changes place."""
    return F.translate(text, *TYPOGRAPHIC)


def cut(text: Column, start: Column, end: Column) -> Column:
    """The code points from start to end."""
    return F.substring(text, start + 1, end - start)


def line_of(text: Column, at: Column) -> Column:
    """1-based line of an offset."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def snippet(text: Column, start: Column, end: Column, context: int = 0) -> Column:
    """A span with some context, inside the text."""
    a, b = F.greatest(F.lit(0), start - context), F.least(F.length(text), end + context)
    return cut(text, a, b)


def shorten(text: Column, most: int, keep: int) -> Column:
    """A text over ``most`` characters as its first ``keep`` and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def containment(claim_tokens: Column, source_tokens: Column) -> Column:
    """Share of the claim's distinct tokens that the source has; 0 for a claim without tokens."""
    n = F.size(F.array_distinct(claim_tokens))
    return F.when(n > 0, F.size(F.array_intersect(claim_tokens, source_tokens)) / n).otherwise(0.0)


def is_claim_like(text: Column) -> Column:
    """It has a digit, or at least five words."""
    return text.rlike(r"(?U)\d") | (F.size(word_list(text)) >= 5)


def strip_artifacts(text: Column) -> Column:
    """Without reasoning blocks and one lead-in phrase."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(bare, r"(?iU)\A\s*(here is[^\n:]*:|here's[^\n:]*:|summary:)\s*", ""))


def numbers(text: Column) -> Column:
    """Numeric tokens, after digits around a typographic separator are joined."""
    return F.regexp_extract_all(F.regexp_replace(text, _SEPARATED, ""), F.lit(NUMBER), F.lit(0))


def numeric_forms(token: Column) -> Column:
    """The ways a numeric token may be written: without commas, and by the parts of a date or ratio.

    Decimals and thousands are never taken apart.
    """
    unpadded = lambda p: F.when(p.rlike("^0+$"), "0").otherwise(F.regexp_replace(p, "^0+", ""))
    part = lambda p: F.when(p.rlike(r"(?U)^\d+$"), F.array(p, unpadded(p))).otherwise(F.array(p))
    parts = F.flatten(F.transform(F.filter(F.split(token, "/"), lambda p: p != ""), part))
    whole = F.array(token, F.replace(token, F.lit(","), F.lit("")))
    return F.array_distinct(F.when(F.contains(token, F.lit("/")), F.concat(whole, parts)).otherwise(whole))


def html_escape(text: Column) -> Column:
    """The five characters that HTML reads, ampersand first."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def strip_tags(markup: Column) -> Column:
    """Markup without its tags."""
    return F.regexp_replace(markup, "<[^>]+>", "")


def docx_text(xml: Column) -> Column:
    """Text of a word-processing body: paragraphs end in a blank line, tabs are tabs, entities stay."""
    out = F.regexp_replace(F.replace(xml, F.lit("</w:p>"), F.lit("\n\n")), "<w:tab[^>]*/>", "\t")
    return F.regexp_replace(strip_tags(out), "\n{3,}", "\n\n")


def quote_pattern(quote: Column) -> Column:
    """A regular expression that finds the quote's words with any white space between them."""
    quoted = F.transform(word_list(fold_typography(quote)), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.array_join(quoted, r"(?U:\s+)")


def duration_seconds(value: Column) -> Column:
    """Seconds of a plain number or of minutes, seconds and milliseconds as in 1m26.4s; null for others."""
    clean, shape = strip(value), r"^(?:(\d+(?:\.\d+)?)m)?(?:(\d+(?:\.\d+)?)s)?(?:(\d+(?:\.\d+)?)ms)?$"
    part = lambda k: F.coalesce(F.expr("try_cast(null as double)") if k is None else F.regexp_extract(clean, shape, k).try_cast("double"), F.lit(0.0))
    timed = F.when((clean != "") & clean.rlike(shape), part(1) * 60 + part(2) + part(3) / 1000)
    return F.coalesce(clean.try_cast("double"), timed)


def citation_title(label: Column, index: Column, start: Column, end: Column) -> Column:
    """A chunk's title: its number, and its label or its place."""
    return F.when(label != "", F.format_string("[%d] %s", index, label)).otherwise(F.format_string("[%d] chars %d-%d", index, start, end))
