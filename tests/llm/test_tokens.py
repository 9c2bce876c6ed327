import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stylograph.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.RANK_FILE), reason="no rank file")
TEXTS = ["", None, " ", "Hello  world\r\n\n x", "émoji 🚲🤷‍♀️ 你好", "<|endoftext|>", "a" * 3000, "  lead and trail  ", "don't we'll\t\tTABS"]


@pytest.fixture(scope="module")
def encoder():
    with open(T.RANK_FILE, "rb") as f:
        return T.build_encoder(f.read())


def test_against_another_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    path = T.RANK_FILE.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    for text in TEXTS[2:]:
        assert T.encode_text(encoder, text) == other.encode(text, add_special_tokens=False).ids


def test_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").withColumn("ids", F.lit("kept"))
    k = T.Tokenizer(spark)
    rows = df.select("i", "ids", k.ids("text").alias("x"), k.n_tokens("text").alias("n"), k.bytes_of(k.ids("text")).alias("b")).orderBy("i").collect()
    assert rows[0].x == [] and rows[1].x == [] and rows[1].b == b"" and rows[0].ids == "kept"
    for row, text in zip(rows, TEXTS):
        assert bytes(row.b).decode() == (text or "") and row.n == len(row.x)
    assert df.limit(0).select(k.ids("text")).count() == 0
    odd = spark.createDataFrame([([None, -1, 10**6, 15496],), (None,)], "ids array<int>").select(k.bytes_of("ids")).collect()
    assert [bytes(r[0]) for r in odd] == [b"Hello", b""]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 .,'\n\t\r  é🚲sdt"), min_size=0, max_size=80), st.integers(1, 9))
def test_pieces_do_not_change_the_ids(text, size):
    with open(T.RANK_FILE, "rb") as f:
        data = f.read()
    encoder = T._encoders.setdefault(0, None) or T._encoders.__setitem__(0, T.build_encoder(data)) or T._encoders[0]
    pieces = list(T.safe_pieces(text, size))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 .'\n\t\x1c\u2003  "), min_size=0, max_size=60), st.integers(2, 5))
def test_long_blank_runs_do_not_change_the_ids(text, size):
    import re

    with open(T.RANK_FILE, "rb") as f:
        data = f.read()
    if not T._encoders.get(0):
        T._encoders[0] = T.build_encoder(data)
    encoder = T._encoders[0]
    parts = list(T.parts_of(text, re.compile(f"[{T._WS}]{{{size},}}")))
    assert "".join(p for p, _ in parts) == text
    assert [i for p, blank in parts if p for i in (encoder._encode_single_piece(p) if blank else encoder.encode_ordinary(p))] == encoder.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n", "\u3000"])
def test_very_long_blank_runs(encoder, blank):
    run = blank * (10**7 // len(blank))
    ids = T.encode_text(encoder, "word" + run + "word" + run)
    assert encoder.decode_bytes(ids) == ("word" + run + "word" + run).encode()
    half = blank * (300_000 // len(blank))
    assert T.encode_text(encoder, f"x{half}y. {half}") == encoder.encode_ordinary(f"x{half}y. {half}")
