"""Exemplar posts: filtered, without repeats, scored and ranked."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.functions import text as T

MIN_WORDS, MAX_WORDS, TOP_N = 6, 60, 400


def candidates(df: DataFrame, banned: Iterable[str] | None = None, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, id_col: str = "pos", text_col: str = "text") -> DataFrame:
    """(id_col, text, words): cleaned texts that pass every filter but that on repeats."""
    rows = df.select(F.col(id_col), F.explode(F.array(T.clean(F.coalesce(F.col(text_col), F.lit(""))))).alias("text"))  # an explode: cleaned once, not for each filter
    rows = rows.withColumn("words", T.n_words(F.col("text")))
    t = F.col("text")
    keep = F.col("words").between(min_words, max_words) & ~T.contains_term(t, banned) & ~t.startswith("RT @") & ~t.startswith(">") & ~T.symbols_only(t)
    return rows.where(keep)


def first_of_each(df: DataFrame, id_col: str = "pos", text_col: str = "text") -> DataFrame:
    """The first row of each text, ignoring case. The first is kept by partial aggregation, so a text that a third of all
    rows share is no hot spot."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    first = df.groupBy(F.lower(text_col).alias("_low")).agg(F.min(F.struct(F.col(id_col), F.col(text_col), *others)).alias("_first"))
    return first.select("_first.*").select(*df.columns)


def score(text: Column, words: Column, on_brand: Column) -> Column:
    """3 on brand, 2 standing alone, 2 ended, 1 of middle length, 1 with a digit."""

    def points(n: int, condition: Column) -> Column:
        return F.when(condition, n).otherwise(0)

    return points(3, on_brand) + points(2, ~T.dependent_opener(text)) + points(2, T.ends_sentence(text)) + points(1, words.between(10, 35)) + points(1, T.has_digit(text))


def scored(df: DataFrame, banned: Iterable[str] | None = None, on_brand: Iterable[str] | None = None, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, id_col: str = "pos", text_col: str = "text") -> DataFrame:
    """(id_col, text, score, on_brand) of every exemplar."""
    rows = first_of_each(candidates(df, banned, min_words, max_words, id_col, text_col), id_col)
    brand = T.contains_term(F.col("text"), on_brand)
    return rows.select(id_col, "text", score(F.col("text"), F.col("words"), brand).alias("score"), brand.alias("on_brand"))


def curate(df: DataFrame, banned: Iterable[str] | None = None, on_brand: Iterable[str] | None = None, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, top_n: int = TOP_N, id_col: str = "pos", text_col: str = "text") -> DataFrame:
    """The best `top_n` exemplars, best first, equal scores in input order (by `id_col`)."""
    return scored(df, banned, on_brand, min_words, max_words, id_col, text_col).orderBy(F.desc("score"), F.asc(id_col)).limit(top_n)
