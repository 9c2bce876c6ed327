import pytest
from pyspark.sql import functions as F

from stylograph.llm import mixing


def frames(spark, n=400):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, " SMALL ").when(F.col("id") % 2 == 0, "big").otherwise("Mid").alias("source"), (F.col("id") % 7 + 1).alias("size"))
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.4, 5), ("missing", 0.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


@pytest.mark.parametrize("rows_in_slice", [10, 50_000])
def test_shares_repeats_and_order(spark, monkeypatch, rows_in_slice):
    monkeypatch.setattr(mixing, "SLICE_ROWS", rows_in_slice)
    docs, targets = frames(spark)
    mixed = mixing.mix(docs, targets, F.col("size")).cache()
    rows = mixed.orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert set(got) == {"big", "mid", "small"}
    for s, share, most in (("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.4, 5)):
        assert abs(got[s].actual_share - share) < 0.02 and got[s].most_uses <= most
    assert len({(r.doc_id, r.use) for r in rows}) == len(rows)
    # every prefix is mixed: half of the mix has the same shares
    half = rows[: len(rows) // 2]
    small = sum(r.n_tokens for r in half if r.source == "small") / sum(r.n_tokens for r in half)
    assert abs(small - 0.4) < 0.05


def test_slices_do_not_matter(spark, monkeypatch):
    docs, targets = frames(spark)
    want = sorted(map(tuple, mixing.mix(docs, targets, F.col("size")).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5), targets, F.col("size")).collect())) == want


def test_budget_and_odd_rows(spark):
    docs, targets = frames(spark)
    mixed = mixing.mix(docs, targets, F.col("size"), budget=100)
    assert 90 <= mixed.agg(F.sum("n_tokens")).first()[0] <= 100
    odd = docs.withColumns({"source": F.lit(None).cast("string"), "share": F.lit(1), "total": F.lit(2)})
    assert mixing.mix(odd, targets, F.col("size")).count() == 0
    assert mixing.mix(docs.unionByName(docs), targets, F.col("size")).count() == mixing.mix(docs, targets, F.col("size")).count()
    assert mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("bigint")), targets, F.col("size")).count() == 0
    assert mixing.mix(docs.limit(0), targets, F.col("size")).count() == 0
    assert mixing.mix(docs, targets.limit(0), F.col("size")).count() == 0
    assert mixing.mix(docs, targets, F.lit(0)).count() == 0
    assert mixing.shares(mixing.mix(docs.limit(0), targets, F.col("size")), targets).agg(F.sum("tokens")).first()[0] == 0


def test_the_mix_is_in_order_over_its_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 50)
    docs, targets = frames(spark)
    rows = mixing.mix(docs, targets, F.col("size")).collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    half = mixing.mix(docs, targets, F.col("size"), budget=500).collect()
    assert half == rows[: len(half)] and sum(r.n_tokens for r in half) <= 500 < sum(r.n_tokens for r in rows[: len(half) + 1])
