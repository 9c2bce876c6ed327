"""The style of a corpus: tokens once, then counts by token, from which all measures follow.

DataFrames hold exact counts and unrounded ratios; `collect_profile` rounds as the rendered guide needs it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stylograph.functions import text as T
from stylograph.functions.lexicons import COORDINATORS, FUNCTION_WORDS, POS_GROUPS, STOPWORDS, SUBORDINATORS, TAG_ENDINGS, TAG_WORDS
from stylograph.plans.scale import stage

TOP_PUNCTUATION, TOP_WORDS = 20, 60


@dataclass(frozen=True)
class StyleProfile:
    n_posts: int
    n_tokens: int
    sent_len_mean: float
    sent_len_sd: float
    sents_per_post_mean: float
    one_sentence_post_pct: float
    subordinator_per_1k: float
    coordinator_per_1k: float
    comma_sentence_pct: float
    pos_mix: dict[str, float] = field(default_factory=dict)
    mean_word_len: float = 0.0
    long_word_pct: float = 0.0
    type_token_ratio: float = 0.0
    function_word_per_1k: dict[str, float] = field(default_factory=dict)
    punctuation_per_1k: dict[str, float] = field(default_factory=dict)
    top_content_words: list[tuple[str, int]] = field(default_factory=list)


def cleaned(df: DataFrame, min_words: int = 3, id_col: str = "pos", text_col: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """(group, pos, text): cleaned texts of `min_words` or more words; null texts count as empty."""
    rows = df.select(*group, F.col(id_col).alias("pos"), F.explode(F.array(T.clean(F.coalesce(F.col(text_col), F.lit(""))))).alias("text"))  # cleaned once, not for each later use
    return rows.where(T.n_words(F.col("text")) >= min_words)


def sentence_rows(posts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, pos, sent_idx, sentence)."""
    return posts.select(*group, "pos", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))


def token_rows(sentences: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, pos, sent_idx, tok_idx, token)."""
    return sentences.select(*group, "pos", "sent_idx", F.posexplode(T.tokens(F.col("sentence"))).alias("tok_idx", "token"))


def vocabulary(tokens: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, token, n, first): how often each token occurs and where first. Combined before the shuffle, so frequent
    tokens are no hot spot."""
    return tokens.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "sent_idx", "tok_idx")).alias("first"))


def alpha_vocabulary(vocab: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, word, n, first) of the alphabetic tokens in lower case."""
    rows = vocab.where(T.is_alpha_word(F.col("token")))
    return rows.groupBy(*group, F.lower("token").alias("word")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _sentence_sums(posts: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, pos, sent_idx, tokens, n_posts, n_sentences, l, q, c, one): a row a sentence with its tokens and what it adds to the sentence measures:
    its tokens, their square, whether it has a comma; the first of a post counts the post, and whether it is its only one."""
    rows = posts.withColumn("sentences", T.sentences(F.col("text"))).select(*group, "pos", "sentences", F.posexplode("sentences").alias("sent_idx", "sentence"))
    rows = rows.select(*group, "pos", "sent_idx", F.size("sentences").alias("s"), "sentence", F.explode(F.array(T.tokens(F.col("sentence")))).alias("tokens"))  # an explode: tokens are made once

    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0).cast("bigint")

    first, length = F.col("sent_idx") == 0, F.size("tokens").cast("bigint")
    return rows.select(
        *group, "pos", "sent_idx", "tokens", flag(first).alias("n_posts"), F.lit(1).cast("bigint").alias("n_sentences"), length.alias("l"), (length * length).alias("q"), flag(F.contains("sentence", F.lit(","))).alias("c"),
        flag(first & (F.col("s") == 1)).alias("one"),
    )


_SUMS = ("n_posts", "n_sentences", "l", "q", "c", "one")


def _sentence_measures() -> list[Column]:
    n = F.col("n_sentences")
    return [
        F.col("n_posts"), n, (F.col("l") / n).alias("sent_len_mean"), (F.sqrt((n * F.col("q") - F.col("l") * F.col("l")).cast("double")) / n).alias("sent_len_sd"), (n / F.col("n_posts")).alias("sents_per_post_mean"),
        (F.col("one") / F.col("n_posts") * 100).alias("one_sentence_post_pct"), (F.col("c") / n * 100).alias("comma_sentence_pct"),
    ]


def sentence_stats(posts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, n_posts, n_sentences, sent_len_mean, sent_len_sd, sents_per_post_mean, one_sentence_post_pct, comma_sentence_pct) of cleaned
    posts; posts without a sentence are no part. One shuffle, of one row a group and task."""
    sums = _sentence_sums(posts, group).groupBy(*group).agg(*(F.sum(x).alias(x) for x in _SUMS))
    return sums.where("n_sentences > 0").select(*group, *_sentence_measures())


def measured(posts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The vocabulary (group, token, n, first) of cleaned posts with the sums of the sentence measures in one row with a null token: everything the
    style measures need, from one pass over the posts and one shuffle of the vocabulary's size."""
    sums = _sentence_sums(posts, group)
    places = F.concat(F.array(F.lit(None).cast("string")), "tokens")
    rows = sums.select(*group, "pos", "sent_idx", *_SUMS, F.posexplode(places).alias("tok_idx", "token"))
    own = {x: F.sum(F.when(F.col("tok_idx") == 0, F.col(x))) for x in _SUMS}
    return rows.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "sent_idx", "tok_idx")).alias("first"), *(v.alias(k) for k, v in own.items()))


def _word_sums() -> list[Column]:
    """Sums over the alphabetic words of a vocabulary; a row without a word counts for nothing."""
    n, w = F.col("n"), F.col("word")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return [
        total(w.isNotNull()).alias("n_tokens"), F.count(w).alias("n_types"), total(w.isin(SUBORDINATORS)).alias("sub"), total(w.isin(COORDINATORS)).alias("coord"), F.sum(F.when(w.isNotNull(), n * F.length(w))).alias("chars"),
        total(F.length(w) > 6).alias("long"),
    ]


def _word_measures() -> list[Column]:
    t = F.col("n_tokens")
    return [
        t, F.col("n_types"), (F.col("sub") / t * 1000).alias("subordinator_per_1k"), (F.col("coord") / t * 1000).alias("coordinator_per_1k"), (F.col("chars") / t).alias("mean_word_len"),
        (F.col("long") / t * 100).alias("long_word_pct"), (F.col("n_types") / t).alias("type_token_ratio"),
    ]


def word_stats(alpha: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, n_tokens, n_types, rates of subordinators and coordinators, word shape) from alphabetic counts."""
    return alpha.groupBy(*group).agg(*_word_sums()).where("n_tokens > 0").select(*group, *_word_measures())


def tag(token: Column) -> Column:
    """A Penn Treebank tag by closed word classes, then endings, then form; knows nothing of the context."""
    low = F.lower(token)
    out = F.when(low.isin(TAG_WORDS["DT"]), "DT")
    for name, words in list(TAG_WORDS.items())[1:]:
        out = out.when(low.isin(words), name)
    out = out.when(~token.rlike(r"\pL"), F.when(token.rlike(r"\pN"), "CD").otherwise("SYM"))
    for name, ending in TAG_ENDINGS:
        out = out.when((F.length(token) > len(ending) + 2) & low.endswith(ending), name)
    return out.otherwise("NN")


def pos_mix(vocab: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, ord, pos_group, pct): every group in order, also those of 0 %."""
    group_of = F.coalesce(*(F.when(F.col("tag").isin(*tags), name) for name, tags in POS_GROUPS.items()))
    counted = vocab.withColumn("tag", tag(F.col("token"))).groupBy(*group).agg(F.sum("n").alias("total"), *(F.sum(F.when(group_of == g, F.col("n")).otherwise(0)).alias(g) for g in POS_GROUPS))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(g).alias("pos_group"), (F.col(g) / F.col("total") * 100).alias("pct")) for i, g in enumerate(POS_GROUPS))))
    return counted.where("total > 0").select(*group, rows.alias("r")).select(*group, "r.*")


def function_word_rates(alpha: DataFrame) -> DataFrame:
    """(ord, word, rate): function words that occur, in the list's order, per 1000 alphabetic tokens."""
    word = F.col("word")
    ordinal = F.array_position(F.array(*map(F.lit, FUNCTION_WORDS)), word).cast("int") - 1
    # one row: the total and at most as many counts as the list has words
    row = alpha.agg(F.sum("n").alias("total"), F.collect_list(F.when(word.isin(FUNCTION_WORDS), F.struct(ordinal.alias("ord"), "word", "n"))).alias("hits"))
    return row.select("total", F.explode("hits").alias("h")).select("h.ord", "h.word", (F.col("h.n") / F.col("total") * 1000).alias("rate"))


def _top(rows: DataFrame, n: int) -> DataFrame:
    """The most frequent rows, equal counts by first occurrence, with their rank from 0."""
    rows = rows.orderBy(F.desc("n"), F.asc("first")).limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first"))) - 1)


def punctuation_rates(vocab: DataFrame, top: int = TOP_PUNCTUATION) -> DataFrame:
    """(rank, mark, rate) of the most frequent punctuation tokens, per 1000 alphabetic tokens."""
    vocab = vocab.select("token", "n", "first").where("first IS NOT NULL")  # both readers below need the same columns, so the vocabulary is shuffled once
    rows = _top(vocab.where(T.is_punctuation(F.col("token"))), top)
    total = vocab.agg(F.sum(F.when(T.is_alpha_word(F.col("token")), F.col("n"))).alias("total"))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")  # a single row
    return rows.select("rank", F.col("token").alias("mark"), (F.col("n") / F.col("total") * 1000).alias("rate"))


def _is_content(excluded: Iterable[str]) -> Column:
    w = F.col("word")
    keep = ~w.isin(STOPWORDS) & (F.length(w) > 2)
    excluded = [x.lower() for x in excluded]
    return keep & ~w.isin(excluded) if excluded else keep


def content_words(alpha: DataFrame, excluded: Iterable[str] = (), top: int = TOP_WORDS) -> DataFrame:
    """(rank, word, n) of the most frequent words that are no stopwords, not excluded and longer than two letters."""
    return _top(alpha.where(_is_content(excluded)), top).select("rank", "word", "n")


def style_scalars(df: DataFrame, min_words: int = 3, id_col: str = "pos", text_col: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """One row (per group): all scalar measures, unrounded; groups without an alphabetic word have none."""
    return _scalars(measured(cleaned(df, min_words, id_col, text_col, group), group), group)


def _scalars(vocab: DataFrame, group: Sequence[str]) -> DataFrame:
    token = F.col("token")
    word = F.when(T.is_alpha_word(token), F.lower(token))
    rows = vocab.where(token.isNull() | word.isNotNull())
    rows = rows.groupBy(*group, word.alias("word")).agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in _SUMS))
    sums = rows.groupBy(*group).agg(*_word_sums(), *(F.sum(x).alias(x) for x in _SUMS))
    return sums.where("n_sentences > 0 AND n_tokens > 0").select(*group, *_sentence_measures(), *_word_measures())


def style_profiles(df: DataFrame, min_words: int = 3, exclude_words: Iterable[str] = (), id_col: str = "pos", text_col: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """The full profile as one row (per group): all scalars, and pos_mix, function_words, punctuation and top_content_words as ordered arrays
    of (name, value): percent, rates per 1000 alphabetic tokens, or a count. The vocabulary is staged once; each measure reads it."""
    group = list(group)
    vocab = stage(measured(cleaned(df, min_words, id_col, text_col, group), group))
    words = vocab.where("token IS NOT NULL")
    alpha = alpha_vocabulary(words, group)
    found = _scalars(vocab, group)
    total = F.col("n_tokens")
    per_group = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc("first"))

    def listed(rows: DataFrame, order: str, name: str, value: Column, as_: str) -> DataFrame:
        return rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(name).alias("name"), value.alias("value")))).alias(as_))

    def best(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(per_group)).where(F.col("place") <= n).withColumn("rank", F.col("place") - 1)  # limited before the shuffle, too

    ordinal = F.array_position(F.array(*map(F.lit, FUNCTION_WORDS)), F.col("word")).cast("int") - 1
    n = F.col("n").cast("double")
    parts = [
        listed(pos_mix(words, group), "ord", "pos_group", F.col("pct"), "pos_mix"),
        listed(alpha.where(F.col("word").isin(FUNCTION_WORDS)).withColumn("ord", ordinal), "ord", "word", n, "function_words"),
        listed(best(words.where(T.is_punctuation(F.col("token"))), TOP_PUNCTUATION), "rank", "token", n, "punctuation"),
        listed(best(alpha.where(_is_content(exclude_words)), TOP_WORDS), "rank", "word", n, "top_content_words"),
    ]
    for part in parts:  # one row a group
        on = group or ["_one"]
        found = found.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), on, "left").drop("_one")

    def scaled(name: str, per_thousand: bool) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<struct<ord:int,name:string,value:double>>"))
        return F.transform(values, lambda x: F.struct(x["name"].alias("name"), (x["value"] / total * 1000 if per_thousand else x["value"]).alias("value")))

    return found.withColumns({"pos_mix": scaled("pos_mix", False), "function_words": scaled("function_words", True), "punctuation": scaled("punctuation", True), "top_content_words": scaled("top_content_words", False)})


def collect_profile(df: DataFrame, min_words: int = 3, exclude_words: Iterable[str] | None = None, id_col: str = "pos", text_col: str = "text") -> StyleProfile:
    """Measure a corpus. ValueError if no text is long enough or no word is alphabetic."""
    row = style_profiles(df, min_words, exclude_words or (), id_col, text_col).first()
    if row is None:
        if not cleaned(df, min_words, id_col, text_col).limit(1).count():
            raise ValueError("no posts left after cleaning and length filtering")
        raise ValueError("no alphabetic words in the corpus")
    rounded = lambda name, digits: {x["name"]: round(x["value"], digits) for x in row[name]}
    return StyleProfile(
        n_posts=row.n_posts, n_tokens=row.n_tokens, sent_len_mean=round(row.sent_len_mean, 2), sent_len_sd=round(row.sent_len_sd, 2), sents_per_post_mean=round(row.sents_per_post_mean, 2),
        one_sentence_post_pct=round(row.one_sentence_post_pct, 1), comma_sentence_pct=round(row.comma_sentence_pct, 1), subordinator_per_1k=round(row.subordinator_per_1k, 1),
        coordinator_per_1k=round(row.coordinator_per_1k, 1), pos_mix=rounded("pos_mix", 2), mean_word_len=round(row.mean_word_len, 2), long_word_pct=round(row.long_word_pct, 1), type_token_ratio=round(row.type_token_ratio, 4),
        function_word_per_1k=rounded("function_words", 2), punctuation_per_1k=rounded("punctuation", 2), top_content_words=[(x["name"], int(x["value"])) for x in row.top_content_words],
    )
