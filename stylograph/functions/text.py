"""Text operators as Column expressions; all are null-safe in that null gives null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylograph.functions import patterns as P
from stylograph.functions.lexicons import DEPENDENT_OPENERS

_ALL = "(?U)"


def strip(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, P.EDGES.replace("$", r"\z"), "")


def clean(text: Column) -> Column:
    """Entities decoded (the ampersand last), links and then leading mentions removed, stripped."""
    text = F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<"))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    return strip(F.regexp_replace(F.regexp_replace(text, P.LINK, ""), P.MENTIONS, ""))


def n_words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(f"{P.NOT_WS}+"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({P.NOT_WS}+)"), F.lit(1))


def is_alpha_word(token: Column) -> Column:
    return token.rlike(P.ALPHA)


def is_punctuation(token: Column) -> Column:
    return token.rlike(P.PUNCTUATION)


def symbols_only(text: Column) -> Column:
    return text.rlike(P.SYMBOLS_ONLY.replace("$", r"\z"))


def dependent_opener(text: Column) -> Column:
    """Whether the text opens like a reply or a continuation."""
    return text.rlike(rf"(?iuU)^(?:{'|'.join(DEPENDENT_OPENERS)})\b")


def has_digit(text: Column) -> Column:
    return text.rlike(P.DIGIT)


def ends_sentence(text: Column) -> Column:
    """Whether the last visible character is . ! or ?; an empty text counts as ended."""
    bare = strip(text)
    return (bare == "") | F.right(bare, F.lit(1)).isin(".", "!", "?")


def quote_java(term: str) -> str:
    """A literal term in a pattern that Java and RE2 read alike."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)


def contains_term(text: Column, terms: Iterable[str] | None) -> Column:
    """Whether any term occurs as whole words, ignoring case; without terms nothing does."""
    terms = [t for t in terms or []]
    if not terms:
        return F.lit(False)
    return text.rlike(rf"(?iuU)\b(?:{'|'.join(map(quote_java, terms))})\b")


def only_mentions(text: Column) -> Column:
    """Whether nothing visible is left without the leading mentions."""
    return strip(F.regexp_replace(text, P.MENTIONS, "")) == ""


def strip_quotes(text: Column) -> Column:
    """Without one pair of equal quotes around the whole text."""
    first = F.left(text, F.lit(1))
    quoted = (F.length(text) >= 2) & (first == F.right(text, F.lit(1))) & first.isin('"', "'")
    return F.when(quoted, strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block: without the first line and from the last fence on; null if the fence has no
    line of its own."""
    inside = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)\z", 1), r"(?s)```(?:(?!```).)*\z", "")
    return F.when(~text.startswith("```"), text).when(F.contains(text, F.lit("\n")), inside)


def decision(text: Column) -> Column:
    """True only for an answer that starts with INTERJECT; null counts as no."""
    return F.coalesce(F.upper(strip(text)).startswith("INTERJECT"), F.lit(False))


def bullets(items: Column) -> Column:
    """One line per item."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def counted(text: Column) -> Column:
    """The text after its number of characters, in a field of three places or more."""
    return F.format_string("[%3dc] %s", F.length(text), text)


def sentences(text: Column) -> Column:
    """Sentences in order, without empty ones."""
    for pattern, replacement in P.SENTENCE_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    parts = F.transform(F.split(text, P.CUT), lambda s: strip(F.replace(s, F.lit(P.DOT), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def tokens(sentence: Column) -> Column:
    """Word tokens of one sentence."""
    text = F.regexp_replace(sentence, P.WS, " ")
    for pattern, replacement in P.TOKEN_RULES:
        text = F.regexp_replace(text, pattern.replace("$", r"\z") if pattern.endswith("$") else pattern, replacement)
    return F.filter(F.split(text, " +"), lambda t: t != "")
