import json

from pyspark.sql import functions as F

from stylograph.llm import dedup
from stylograph.plans import scale

TEXTS = ["Hello, World!", "hello world", "HELLO-WORLD...", "other", None, "", " ?! ", "Straße 1", "STRASSE 1", "hello world", "h e l l o w o r l d"]


def frame(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "pos bigint, text string")


def test_text_copies(spark):
    keyed = dedup.text_keys(frame(spark, TEXTS), "t", "pos")
    got = sorted(map(tuple, dedup.copies(keyed).collect()))
    assert got == [("t", 1, 2), ("t", 1, 3), ("t", 1, 10), ("t", 1, 11), ("t", 8, 9)]
    assert sorted(map(tuple, dedup.collapsed(keyed).collect())) == [("t", 1, 5), ("t", 4, 1), ("t", 8, 2)]


def test_hot_keys_take_the_salted_path(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_LEAST", 20)
    texts = ["The Same"] * 60 + [f"text {i // 2}" for i in range(80)]
    keyed = dedup.text_keys(frame(spark, texts), "t", "pos")
    got = sorted((r.keep_id, r.copy_id) for r in dedup.copies(keyed).collect())
    want = [(1, i) for i in range(2, 61)] + [(i, i + 1) for i in range(61, 140, 2)]
    assert got == want
    assert {r.keep_id: r.n_copies for r in dedup.collapsed(keyed).collect()}[1] == 60


def test_raw_records(spark):
    base = {"id_str": "7", "full_text": "Some text.", "created_at": "c", "lang": "en", "in_reply_to_status_id_str": None}
    bare = {"lang": "en", "text": "SOME   text", "id": 7, "created_at": "c"}
    records = [
        json.dumps({"tweet": base}), json.dumps(bare), json.dumps({**base, "lang": "de"}), json.dumps({"tweet": base})[:-1], json.dumps({"tweet": base}) + ",", f"[{json.dumps(base)}]", None, "",
        json.dumps({**bare, "in_reply_to_status_id_str": ""}, indent=2), json.dumps({**bare, "text": "!"}), '"tweet": ' + json.dumps(base), "null", json.dumps({"tweet": "no record", **base}),
    ]
    df = spark.createDataFrame([(i + 1, r) for i, r in enumerate(records)], "raw_id bigint, record string")
    assert sorted((r.keep_id, r.copy_id) for r in dedup.copies(dedup.raw_keys(df)).collect()) == [(1, 2), (1, 9), (1, 13)]


def test_nulls_repeats_clashes_and_empty(spark):
    df = frame(spark, ["a b", "ab"]).withColumns({"key": F.lit(1), "tbl": F.lit("x"), "canon": F.lit(2), "rec_id": F.lit(3)})
    keyed = dedup.text_keys(df.unionByName(df), "t", "pos")
    assert {(r.keep_id, r.copy_id) for r in dedup.copies(keyed).collect()} == {(1, 2)}
    lost = spark.createDataFrame([(None, "ab"), (5, "ab")], "pos bigint, text string")
    assert dedup.copies(dedup.text_keys(lost, "t", "pos")).count() == 0
    empty = dedup.text_keys(frame(spark, []), "t", "pos")
    assert dedup.copies(empty).count() == 0 and dedup.collapsed(empty).count() == 0
    assert dedup.text_keys(frame(spark, ["x" * 500_000, "X" * 500_000]), "t", "pos").select("key").distinct().count() == 1
