import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograph.llm import quality as Q

COMMON = "the of and a to in is you that it for on are as with i at this have from or had by not what all were we".split()
PROSE = [f"The {a} was {b}, and we had to walk to the {c} in the rain. It is not what I had in mind." for a in ("boat", "bus", "door") for b in ("late", "gone", "locked") for c in ("shop", "park", "pier", "mill")]
LISTS = [f"- {a} lamp\n- buy {b}\n- 12 {c}\n- warm {a}" for a in ("oak", "tin") for b in ("milk", "tea") for c in ("nails", "cups", "pens")] + ["red apple / green pear / sweet plum / old cheese / new bread / cold milk / salt"]
TABLES = [f"| {a} | 12.5 | 33% |\n| {b} | 9 | 4% |\n| {c} | 88 | 7.1 |" for a in ("Nor", "Sul") for b in ("Ash", "Oak") for c in ("Wes", "Ves", "Ter")] + ["oak: 12\npine: 7\nash: 103\nelm: 88"]
JUNK = ["xqzt vbnm qwrtp kljhg zxcvb pqrst mnbvc lkjhg"] * 4 + ["7f" * 40, "0x12 0x9f 0xaa 0x31 0x77 0x10", "buy now buy now buy now buy now buy now buy now buy now"] * 2
TEXTS = PROSE + LISTS + TABLES + JUNK + ["nice one!", None, "", " \n\t"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos bigint, text string")


def test_kinds(spark):
    got = {r.pos: r.kind for r in Q.kinds(frame(spark, TEXTS), COMMON).collect()}
    want = ["prose"] * len(PROSE) + ["list"] * len(LISTS) + ["table"] * len(TABLES) + ["junk"] * len(JUNK) + ["prose"]
    wrong = [(TEXTS[i], got[i]) for i, k in enumerate(want) if got[i] != k]
    assert not wrong
    assert set(got) == set(range(len(want)))


def test_statistics(spark):
    rows = Q.statistics(frame(spark, ["The cat, the CAT!\n12 %", None, "", "　"]).withColumn("_t", F.lit("x")), COMMON).orderBy("pos").collect()
    r = rows[0]
    assert (r.n_chars, r.n_lines, r.n_words, r.mean_word_len, r.type_token_ratio) == (22, 2, 4, 3.0, 0.5)
    assert r.symbol_ratio == 3 / 17 and r.digit_ratio == 2 / 17 and r.ended_line_share == 0.5 and r.common_word_share == 0.5
    assert all(rows[1][c] == 0 for c in Q.STATISTICS) and rows[3].n_lines == 0 and rows[3].n_chars == 1


def test_empty_and_long(spark):
    assert Q.kinds(frame(spark, []), COMMON).count() == 0 and Q.statistics(frame(spark, []), []).count() == 0
    long = "The boat was late, and we had to walk to the shop in the rain. " * 3000
    got = {r.pos: r.kind for r in Q.kinds(frame(spark, TEXTS + [long]), COMMON).collect()}
    assert got[len(TEXTS)] in ("prose", "junk")  # one phrase over and over


def test_learned_rates():
    """Functions that fire at known rates are given about these rates."""
    rng = np.random.default_rng(2)
    kind_of = [0, 0, 1, 2, 2, 3, 3, 4, 4]
    truth = rng.choice(5, size=20_000, p=[0.6, 0.1, 0.1, 0.1, 0.1])
    own = np.array([0.9, 0.7, 0.8, 0.9, 0.6, 0.9, 0.7, 0.8, 0.9])
    fired = rng.random((len(truth), 9)) < np.where(np.array(kind_of)[None, :] == truth[:, None], own[None, :], 0.03)
    masks, counts = np.unique((fired * (1 << np.arange(9))).sum(1), return_counts=True)
    prior, learned, _ = Q.fit(masks, counts.astype(float), kind_of)
    assert np.abs(learned - own).max() < 0.1 and abs(prior[0] - 0.6) < 0.05


def test_a_table_of_too_many_common_words_is_an_error(spark, tmp_path):
    from stylograph.llm import queries

    def words(n):
        spark.range(n).selectExpr("concat('w', id) AS word").write.mode("overwrite").parquet(f"{tmp_path}/common_words.parquet")
        return queries._common(spark, str(tmp_path))

    assert len(words(10_000)) == 10_000
    with pytest.raises(ValueError, match="more than 10000 rows"):
        words(10_001)
