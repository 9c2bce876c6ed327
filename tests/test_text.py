import pytest
from pyspark.sql import functions as F

from stylograph.functions import text as T


def one(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_clean(spark):
    texts = ["@a @b_1, hello https://x.co/1?y=2 there  ", "&amp;gt; x &lt;b&gt;", " @a hi", "https://x.co @a hi", "", None, " both "]
    assert one(spark, T.clean, *texts) == ["hello  there", "&gt; x <b>", "@a hi", "@a hi", "", None, "both"]


def test_words_and_predicates(spark):
    assert one(spark, T.n_words, "a b c\x1cd", "", " ") == [4, 0, 0]
    assert one(spark, T.is_alpha_word, "word", "n't", "''", "café", "a1") == [True, True, True, False, False]
    assert one(spark, T.is_punctuation, "''", "…", "a.", "_", "!?") == [True, True, False, False, True]
    assert one(spark, T.symbols_only, "12 !?", "___", "", "a1") == [True, False, False, False]
    assert one(spark, T.ends_sentence, "Done. ", "open", "", "why?\n") == [True, False, True, True]
    assert one(spark, T.dependent_opener, "Yes we can", "yesterday", "And then", "and", "android", "That's it", "THIS one") == [True, False, True, False, False, True, True]
    assert one(spark, T.only_mentions, "@a @b, ", "@a x", "") == [True, False, True]


def test_terms_are_whole_words(spark):
    has = lambda c: T.contains_term(c, ["election", "a.b"])
    assert one(spark, has, "the ELECTION!", "elections", "a.b", "axb", "öelection") == [True, False, True, False, False]
    assert one(spark, lambda c: T.contains_term(c, []), "x") == [False]


def test_sentences(spark):
    got = one(spark, T.sentences, "Dr. J. R. Smith met Ann. \"Really?\" Yes!\nNo end", "one\ntwo", "", "...")
    assert got == [["Dr. J. R. Smith met Ann.", '"Really?"', "Yes!", "No end"], ["one\ntwo"], [], ["..."]]


@pytest.mark.parametrize(
    "sentence, tokens",
    [
        ("I don't, really.", ["I", "do", "n't", ",", "really", "."]),
        ('He said "we\'ll go".', ["He", "said", "``", "we", "'ll", "go", "''", "."]),
        ("at 5:30, 1,000 (or so)...", ["at", "5:30", ",", "1,000", "(", "or", "so", ")", "..."]),
        ("it's #1 -- what?!", ["it", "'s", "#", "1", "--", "what", "?", "!"]),
        ("", []),
    ],
)
def test_tokens(spark, sentence, tokens):
    assert one(spark, T.tokens, sentence) == [tokens]


def test_answers(spark):
    assert one(spark, T.strip_quotes, '"hi there"', "'x'", '"x\'', '"', "plain", None) == ["hi there", "x", '"x\'', '"', "plain", None]
    assert one(spark, T.decision, " interject now", "SILENT", "", None, "INTERJECTING") == [True, False, False, False, True]
    assert one(spark, T.strip_fence, "```json\n[1]\n```", "[1]", "```", "```x\na```b\n```z") == ["[1]\n", "[1]", None, "a```b\n"]
