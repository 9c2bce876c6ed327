from stylograph.operators import exemplars as E

GOOD = "This small engine makes every single page load faster than before."


def posts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos bigint, text string")


def curated(spark, *texts, **kw):
    return [(r.pos, r.score, r.on_brand) for r in E.curate(posts(spark, *texts), **kw).collect()]


def test_filters(spark):
    other = "Another long enough sentence about gardens and old trees."
    assert [p for p, _, _ in curated(spark, "too short", other, other.upper(), " ".join(["w"] * 100), None, "", "1 2 3 4 5 6 7", "RT @x: six words are in this one", "&gt; six words are in this one")] == [1]
    assert [p for p, _, _ in curated(spark, other, "We talk about the big elections of this year now.", banned=["elections"])] == [0]


def test_first_is_kept_after_filtering(spark):
    # the retweet does not pass, so the lower-case form is the first that does
    assert [p for p, _, _ in curated(spark, "RT @a six words are in here", "rt @a six words are in here")] == [1]


def test_scores_and_ties(spark):
    ranked = curated(spark, "yes this is a reply of seven", "The sea is calm in the early light", "The parser handles all the input of today.", "Three of the old boats left again", on_brand=["parser"])
    assert ranked == [(2, 7, True), (1, 2, False), (3, 2, False), (0, 0, False)]
    assert all(0 <= s <= 9 for _, s, _ in ranked)


def test_top_n_and_partitions(spark):
    texts = [f"A steady sentence of number {i} with enough words in it{'.' if i % 3 else ''}" for i in range(60)]
    df = posts(spark, *texts)
    want = [r.pos for r in E.curate(df, top_n=25).collect()]
    assert len(want) == 25
    for n in (1, 7):
        assert [r.pos for r in E.curate(df.repartition(n), top_n=25).collect()] == want


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    df = posts(spark, GOOD).withColumns({"words": F.lit(1), "score": F.lit("x"), "on_brand": F.lit(None).cast("string")})
    assert E.curate(df).columns == ["pos", "text", "score", "on_brand"]
    assert E.curate(posts(spark).limit(0)).count() == 0
