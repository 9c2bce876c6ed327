from pyspark.sql import functions as F

from stylograph.plans import scale


def test_running_sums(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("s"), "id", F.lit(2).alias("v"))
    got = {r.id: r.out for r in scale.running_sums(rows, {"v": "out"}, ["g"], "s", ["id"]).collect()}
    want = {}
    for g in (0, 1):
        total = 0
        for i in sorted((i for i in range(200) if i % 2 == g), key=lambda i: (i % 7, i)):
            total += 2
            want[i] = total
    assert got == want


def test_skew_join(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_LEAST", 10)
    rows = spark.range(300).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = rows.where("id < 160 OR id % 2 = 0").select("k").distinct().withColumn("x", F.col("k") * 2)
    got = scale.skew_join(rows, found, ["k"], counts, 300)
    want = rows.join(found, "k")
    assert sorted(map(tuple, got.select("k", "id", "x").collect())) == sorted(map(tuple, want.select("k", "id", "x").collect()))
    assert scale.skew_join(rows, found, ["k"], counts, 300, "left_semi").count() == want.count()


def test_stage_and_cut(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(map(tuple, scale.stage(df).collect())) == [(1, None), (2, "x")] == sorted(map(tuple, scale.cut(df).collect()))


def test_many_hot_keys_take_a_salted_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_LEAST", 3)
    monkeypatch.setattr(scale, "HOT_ROWS", 3)
    monkeypatch.setattr(scale, "MOST_BROADCAST", 2)
    rows = spark.range(400).select((F.col("id") % 50).alias("k"), "id").unionByName(spark.range(20).selectExpr("id + 1000 AS k", "id"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = scale.hot_keys(counts, ["k"], 420)
    assert hot.count() == 50
    warm, cold = scale.split_hot(rows, hot, ["k"])
    assert warm.count() == 400 and cold.count() == 20
    found = rows.where("k % 3 = 0").select("k").distinct().withColumn("x", F.col("k") * 2)
    got, want = scale.skew_join(rows, found, ["k"], counts, 420), rows.join(found, "k")
    assert sorted(map(tuple, got.select("k", "id", "x").collect())) == sorted(map(tuple, want.select("k", "id", "x").collect()))


def test_hot_keys_by_rows_of_a_task(spark, monkeypatch):
    counts = spark.createDataFrame([("a", 2_000_000), ("b", 900_000), ("c", 10)], "k string, n bigint")
    assert [r.k for r in scale.hot_keys(counts, ["k"], 10**11).collect()] == ["a"]
    assert sorted(r.k for r in scale.hot_keys(counts, ["k"], 3_000_000).collect()) == ["a", "b"]


def test_staged_tables_end_with_their_scope(spark):
    import os
    from urllib.parse import urlparse

    folder = urlparse(scale.checkpoint_dir(spark)).path
    tables = lambda: {x for x in os.listdir(folder) if x.startswith("stage-")}
    before = tables()
    with scale.staged_tables(spark):
        assert scale.stage(spark.range(5)).count() == 5
        assert len(tables() - before) == 1
    assert tables() == before
