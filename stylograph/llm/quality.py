"""Problem 4: text statistics of each record, and its kind: prose, list, table or junk.

Thresholds on the statistics are noisy labelling functions. Each fires or not and votes for one kind. How often a
function fires on its own kind and on others, and how common the kinds are, is learned from agreements by
expectation-maximization over the counts of vote patterns (at most 2 ** number of functions, so they fit the
driver whatever the data). The posterior of each pattern is the posterior of its records.

Defined results: null, empty and blank texts have zero statistics (ratios 0.0) and kind null; short remarks count as prose; ties of the
posterior go to the first of prose, remark, list, table, junk; repeated rows get the same result each; further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.plans.scale import stage

#: Latent types; a remark is prose too short for the measures of sentences, and is reported as prose.
KINDS = ("prose", "remark", "list", "table", "junk")
#: Frequent function words of other languages than the table of common words holds. Fixed values.
OTHER_COMMON = (
    "der die das und ist ein eine nicht mit für auf von zu im bei ohne wer wird auch sollte ich mein war noch schon so heute gestern "
    "el la los las un una y es de del con sin que se no su más pero hoy ayer si cada me cerca porque estaba sigue otra vez "
    "le les une et est des du sous avec sans pour chaque je mon ou aussi était reste près on a au"
).split()

_WS = r"[\s\x{85}\p{Z}\x{200b}\x{feff}]+"
_TRIM = r"^[\s\x{85}\p{Z}\x{200b}\x{feff}]+|[\s\x{85}\p{Z}\x{200b}\x{feff}]+\z"
_LINE = r"[\n\r\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]+"
_WORD = r"\p{L}+(?:['’]\p{L}+)*"
_END = r"[.!?…。][\"'”»)\]_*]*\s*\z"
_LINK = r"https?://\S+|www\.\S+"
_BULLET = r"^\s*(?:[-*•→✓·–+>]|\[[ xX]?\]|\(?(?:\d{1,3}|[A-Za-z])[.):\]])\s+\S"
_CELLS = r"\S(?:\t+| {2,})\S"
_PAIR = r"^(?!\s*\(?(?:\d{1,3}|[A-Za-z])[.):\]]\s)[^:=]{1,60}[:=]\s*\S{1,24}(?: \S{1,12})?\s*\z"
_VALUE = r"^\s*\S.*[\s,;|:]\d[\d.,/-]*%?(?:[\s,;|]|\z)"
_JOINED = r"^[^,;]+(?:[,;][^\s,;][^,;]*)+\z"
_MARKUP = r"</?[A-Za-z][^<>]*>|&[a-z]+;"
_MAY_CODE = r"\p{N}|(?:^|[\s\x{85}\p{Z}\x{200b}\x{feff}])[\p{P}\p{S}]+(?:[\s\x{85}\p{Z}\x{200b}\x{feff}]|\z)"
_VOWEL = r"[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ]"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def statistics(df: DataFrame, common: list[str], id_col: str = "pos", text_col: str = "text") -> DataFrame:
    """(id_col, STATISTICS) per record: simple counts and ratios, all by built-in functions.

    `common` are common words (a bounded list).
    """
    t = F.col("_t")
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select(id_col, "_t", F.filter(F.split("_t", _LINE), lambda x: F.regexp_replace(x, _TRIM, "") != "").alias("_lines"), F.regexp_extract_all(F.lower("_t"), F.lit(_WORD), F.lit(0)).alias("_words"))
    words, lines = F.col("_words"), F.col("_lines")
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    known = sorted(set(common))
    visible = F.length(F.regexp_replace(t, _WS, ""))
    return rows.select(
        id_col,
        F.length(t).cast("bigint").alias("n_chars"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(words).cast("bigint").alias("n_words"),
        _share(letters, F.size(words)).alias("mean_word_len"),
        _share(F.size(F.array_distinct(words)), F.size(words)).alias("type_token_ratio"),
        _share(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s\x{85}\p{Z}\x{200b}\x{feff}]+", "")), visible).alias("symbol_ratio"),
        _share(F.length(F.regexp_replace(t, r"[^\p{N}]+", "")), visible).alias("digit_ratio"),
        _share(F.size(F.filter(lines, lambda x: x.rlike(_END))), F.size(lines)).alias("ended_line_share"),
        _share(F.size(F.filter(words, lambda w: w.isin(known))), F.size(words)).alias("common_word_share"),
    )


STATISTICS = ("n_chars", "n_lines", "n_words", "mean_word_len", "type_token_ratio", "symbol_ratio", "digit_ratio", "ended_line_share", "common_word_share")


def _functions(common: list[str]) -> list[tuple[str, str, Column]]:
    """(name, kind, condition) of each labelling function, over the columns of `_measures`."""
    c = F.col
    multi = c("lines") >= 3
    no_prose = (c("sentence_share") < 0.34) & (c("function_share") < 0.3)
    items = (c("lines") <= 2) & (c("inline_items") >= 5) & (c("words") <= 3.2 * c("inline_items"))
    rows = (c("lines") >= 2) & ((c("cell_lines") >= 0.3) | (c("pair_lines") >= 0.3) | (c("delimited_lines") >= 0.3))
    return [
        ("sentences", "prose", (c("sentence_share") >= 0.5) & ~items),
        ("function_words", "prose", (c("function_share") >= 0.2) & (c("words") * 2 >= c("tokens")) & (c("repeat_share") < 0.5) & ~items & ~(multi & (c("bullet_lines") >= 0.6))),
        ("short_remark", "remark", (c("tokens") <= 7) & (c("lines") <= 2) & (c("longest") <= 24) & (c("markup_share") < 0.2) & (c("code_share") < 0.5) & (c("tag_share") < 0.75) & ~rows),
        ("bullets", "list", multi & (c("bullet_lines") >= 0.6)),
        ("short_lines", "list", (c("lines") >= 4) & (c("words") <= 5 * c("lines")) & no_prose & ~rows & (c("value_lines") < 0.5)),
        ("inline_items", "list", items),
        ("tag_run", "list", (c("tag_share") >= 0.75) & (c("raw_tokens") >= 4)),
        ("quantities", "list", multi & (c("quantity_lines") >= 0.5)),
        ("delimited", "table", (c("lines") >= 2) & (c("delimited_lines") >= 0.6)),
        ("columns", "table", (c("lines") >= 2) & (c("cell_lines") >= 0.6)),
        ("pairs", "table", multi & (c("pair_lines") >= 0.6)),
        ("value_rows", "table", multi & (c("value_lines") >= 0.5) & (c("words") > 0) & no_prose & (c("bullet_lines") < 0.5)),
        ("no_vowels", "junk", (c("long_words") >= 4) & (c("voweled_share") < 0.6)),
        ("codes", "junk", ((c("code_share") >= 0.5) & (c("tokens") >= 5) & (c("lines") <= 2)) | (c("longest") >= 48)),
        ("markup", "junk", (c("markup_share") >= 0.4) | (c("quote_share") >= 0.12)),
        ("signs", "junk", (c("words") == 0) & (c("sign_share") >= 0.7) & (c("longest") >= 8)),
        ("repeats", "junk", (c("tokens") >= 8) & (c("repeat_share") >= 0.5)),
        ("broken_letters", "junk", c("broken_share") >= 0.06),
    ]


def _measures(rows: DataFrame, common: list[str]) -> DataFrame:
    """Measures for the labelling functions of `_t`, beside all columns of `rows`."""
    known = sorted(set(common) | set(OTHER_COMMON))

    def is_common(w: Column) -> Column:
        return w.isin(known)

    rows = rows.withColumn("_raw", F.filter(F.split("_t", _WS), lambda x: x != ""))
    body = F.regexp_replace(F.regexp_replace("_t", _LINK, " "), r"(^|[\s(])[@#][\p{L}\p{N}_]+[:,]?", "$1")
    rows = rows.withColumn("_body", F.regexp_replace(body, r"^(?:RT\s*:?)?\s+", ""))
    rows = rows.withColumns({"_lines": F.filter(F.split("_body", _LINE), lambda x: F.regexp_replace(x, _TRIM, "") != ""), "_tokens": F.filter(F.split("_body", _WS), lambda x: x != ""), "_low": F.filter(F.split(F.lower("_body"), _WS), lambda x: x != ""), "_words": F.regexp_extract_all(F.lower("_body"), F.lit(_WORD), F.lit(0))})
    lines, words, tokens = F.col("_lines"), F.col("_words"), F.col("_tokens")
    n_lines = F.size(lines)

    def line_share(pattern: str) -> Column:
        # no function asks for the lines of a text that has only one
        return F.when(n_lines >= 2, _share(F.size(F.filter(lines, lambda x: x.rlike(pattern))), n_lines)).otherwise(F.lit(0.0))

    def only(condition: Column, measure: Column) -> Column:
        """The measure, which is 0 for sure where a cheap condition does not hold."""
        return F.when(condition, measure).otherwise(F.lit(0.0))

    t = F.col("_t")
    clauses = F.transform(F.split("_body", r"[.!?…。]+(?=\s|\"|”|»|\z)|" + _LINE), lambda s: F.regexp_extract_all(F.lower(s), F.lit(_WORD), F.lit(0)))
    sentences = F.filter(clauses, lambda s: (F.size(s) >= 4) & (F.size(F.filter(s, is_common)) * 6 >= F.size(s)))
    long_words = F.filter(words, lambda w: F.length(w) >= 3)
    inline = F.regexp_replace("_body", _TRIM, "")
    bare = F.length(F.regexp_replace("_t", _WS, ""))
    n = F.size("_low")
    pairs = F.zip_with(F.slice("_low", 1, F.greatest(n - 1, F.lit(0))), F.slice("_low", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return rows.withColumns(
        {
            "lines": n_lines,
            "words": F.size(words),
            "tokens": F.size(tokens),
            "raw_tokens": F.size("_raw"),
            "longest": F.coalesce(F.array_max(F.transform(tokens, lambda x: F.length(x))), F.lit(0)),
            "function_share": _share(F.size(F.filter(words, is_common)), F.size(words)),
            "sentence_share": _share(F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(s)), F.size(words)),
            "bullet_lines": line_share(_BULLET),
            "quantity_lines": line_share(r"\sx\s?\d+\s*\z"),
            "delimited_lines": line_share(r"^[^|]*\|.*\||\S\t.*\S|^\s*[+|][-+=]{4,}|" + _JOINED),
            "cell_lines": line_share(_CELLS + r"|^\s*[+|][-+=|]{4,}"),
            "pair_lines": line_share(_PAIR),
            "value_lines": line_share(_VALUE),
            "inline_items": F.greatest(*(F.floor((F.length(inline) - F.length(F.replace(inline, F.lit(x), F.lit("")))) / len(x)) for x in (" / ", " | ", "; ", ", ", " · ", " • ", " - ", " – ", " → ", " * "))) + 1,
            "tag_share": only(t.contains("@") | t.contains("#") | t.contains("http") | t.contains("www."), _share(F.size(F.filter("_raw", lambda x: x.rlike(r"^(?:[@#][\p{L}\p{N}_]+[,:;.]?|https?://\S+|www\.\S+)\z"))), F.size("_raw"))),
            "long_words": F.size(long_words),
            "voweled_share": only(F.size(long_words) >= 4, _share(F.size(F.filter(long_words, lambda w: w.rlike(_VOWEL) & ~w.rlike(r"[bcdfghjklmnpqrstvwxz]{5,}"))), F.size(long_words))),
            "code_share": only(F.col("_body").rlike(_MAY_CODE), _share(F.size(F.filter(tokens, lambda x: x.rlike(r"^(?:0x[0-9a-fA-F]+|[\p{N}\p{P}\p{S}]+|[A-Za-z]*\d+[A-Za-z0-9]*)\z"))), F.size(tokens))),
            "markup_share": only(t.contains("<") | t.contains("&"), _share(F.length("_t") - F.length(F.regexp_replace("_t", _MARKUP, "")), bare)),
            "quote_share": _share(_count(F.col("_t"), r"[{}\[\]\"]"), bare),
            "sign_share": _share(_count(F.col("_t"), r"[!-/:-@\[-`{-~]"), bare),
            "repeat_share": F.when(n >= 4, 1.0 - _share(F.size(F.array_distinct(pairs)), n - 1)).otherwise(F.lit(0.0)),
            "broken_share": only(t.contains("Ã") | t.contains("â€") | t.contains("\ufffd"), _share(_count(t, r"Ã.|â€|\x{fffd}"), bare)),
        }
    ).drop("_raw", "_body", "_lines", "_words", "_tokens", "_low")


def fit(patterns: np.ndarray, counts: np.ndarray, kind_of: list[int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prior of the kinds, and for each function how often it fires on its kind and on others, by
    expectation-maximization over vote patterns (bits) and their counts."""
    m = len(kind_of)
    fired = (patterns[:, None] >> np.arange(m)[None, :] & 1).astype(float)
    votes = np.zeros((m, len(KINDS)))
    votes[np.arange(m), kind_of] = 1
    usual = np.array([0.6, 0.1, 0.1, 0.1, 0.1])
    # the more functions a kind has, the fewer of them fire on a record of it
    likely = np.clip(1.4 / votes.sum(0), 0.2, 0.8)[np.array(kind_of)]
    prior, own, other = usual, likely, np.full(m, 0.02)
    for _ in range(rounds):
        post = posteriors(fired, votes, prior, own, other)
        weight = post * counts[:, None]
        mass = weight.sum(0)
        on = fired.T @ weight  # function x kind
        # prior beliefs worth some dozens of records: they decide in a small table and vanish in a large one
        prior = (mass + 50 * usual) / (counts.sum() + 50)
        own = ((on * votes).sum(1) + likely * 30) / ((votes * mass).sum(1) + 30)
        other = ((on * (1 - votes)).sum(1) + 0.02 * 200) / (((1 - votes) * mass).sum(1) + 200)
        other = np.minimum(other, 0.9 * own)  # a vote never speaks against its own kind
    return prior, own, other


def posteriors(fired: np.ndarray, votes: np.ndarray, prior: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    rate = votes * own[:, None] + (1 - votes) * other[:, None]
    log = np.log(prior)[None, :] + fired @ np.log(rate) + (1 - fired) @ np.log1p(-rate)
    log -= log.max(1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(1, keepdims=True)


def kinds(df: DataFrame, common: list[str], id_col: str = "pos", text_col: str = "text") -> DataFrame:
    """(id_col, kind, confidence): the kind of each record that is not blank, with its posterior."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).where(F.regexp_replace("_t", _TRIM, "") != "")
    functions = _functions(common)
    mask = sum((F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, _, cond) in enumerate(functions)), F.lit(0))
    voted = stage(_measures(rows, common).select(id_col, mask.alias("votes")))  # read twice: for the counts and for the result
    found = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 ** len(functions) rows
    patterns, counts = np.array([r.votes for r in found], dtype=np.int64), np.array([r.n for r in found], dtype=float)
    kind_of = [KINDS.index(k) for _, k, _ in functions]
    schema = "votes int, kind string, confidence double"
    if not len(patterns):
        table = df.sparkSession.createDataFrame([], schema)
    else:
        fired = (patterns[:, None] >> np.arange(len(kind_of))[None, :] & 1).astype(float)
        votes = np.zeros((len(kind_of), len(KINDS)))
        votes[np.arange(len(kind_of)), kind_of] = 1
        post = posteriors(fired, votes, *fit(patterns, counts, kind_of))
        best = post.argmax(1)
        table = df.sparkSession.createDataFrame([(int(p), KINDS[b] if KINDS[b] != "remark" else "prose", float(post[i, b] if b > 1 else post[i, :2].sum())) for i, (p, b) in enumerate(zip(patterns, best))], schema)
    return voted.join(F.broadcast(table), "votes").select(id_col, "kind", "confidence")
