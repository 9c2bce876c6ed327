import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stylograph.llm import spans as S


def brute(docs, length):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    out = []
    for d, t in docs:
        run = None
        for i in range(len(t or "") - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + length
                else:
                    out += [(d, *run)] if run else []
                    run = [i, i + length]
        out += [(d, *run)] if run else []
    return sorted(set(out))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def made(seed, n=14, alphabet="abcd é🚲"):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passages = [word(r.randint(25, 70)) for _ in range(4)] + ["ab" * 40, "a" * 60]
    return [(i, "".join(r.choice([word(r.randint(1, 30)), r.choice(passages)[r.randint(0, 8) :], r.choice(passages)]) for _ in range(r.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("seed, in_tree, part", [(1, 512, 1 << 20), (2, 1, 1 << 20), (3, 4, 64)])
def test_against_brute_force(spark, monkeypatch, seed, in_tree, part):
    monkeypatch.setattr(S, "PART", part)
    docs = [*made(seed), (100, None), (101, ""), (102, "short")]
    got = sorted(map(tuple, S.shared_spans(frame(spark, docs), 20, in_tree).collect()))
    assert got == brute(docs, 20)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_equal_spans_choose_equal_suffixes(seed):
    import numpy as np

    r = random.Random(seed)
    shared = "".join(r.choice("abc") for _ in range(24))
    a, b = "x" * r.randint(0, 40) + shared + "yz" * r.randint(0, 20), "".join(r.choice("abc") for _ in range(30)) + shared + "q"
    inside = []
    for text in (a, b):
        places, grams = S.chosen(S._codes(text), np.array([len(text)]), 24)
        at = text.index(shared)
        inside.append({(int(p) - at, int(g)) for p, g in zip(places, grams) if at <= p <= at + 12})
    assert inside[0] & inside[1]


def test_repeats_within_a_document_and_repeated_rows(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    assert S.shared_spans(frame(spark, [(1, text + "#" + text)]), 50).count() == 0
    assert S.shared_spans(frame(spark, [(1, text), (1, text), (None, text)]), 50).count() == 0
    rows = frame(spark, [(1, text), (1, text), (2, text)])
    assert sorted(map(tuple, S.shared_spans(rows, 50).collect())) == [(1, 0, len(text)), (2, 0, len(text))]
    amounts = {r.doc_id: r.shared_share for r in S.shared_amounts(frame(spark, [(1, text), (2, text), (3, None)]), S.shared_spans(rows, 50)).collect()}
    assert amounts == {1: 1.0, 2: 1.0, 3: 0.0}


def test_hot_passage_empty_and_clashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from stylograph.plans import scale

    monkeypatch.setattr(scale, "HOT_LEAST", 10)
    passage = "".join(chr(97 + (i * 7) % 26) for i in range(41)) + "0123456789" * 2
    docs = [(i, f"{i:05d}{i * 37:07d}" + passage + f"{i * 91:07d}{i:05d}" * 4) for i in range(40)]
    got = sorted(map(tuple, S.shared_spans(frame(spark, docs).withColumns({"place": F.lit(1), "prefix": F.lit("x")}), 30, 8).collect()))
    assert got == brute(docs, 30)
    assert S.shared_spans(frame(spark, []), 30).count() == 0


def rotated(word, n, at=0):
    return (word * (n // len(word) + 2))[at : at + n]


@pytest.mark.parametrize("in_tree", [20_000, 2])
@pytest.mark.parametrize("seed", range(3))
def test_periodic_texts(spark, seed, in_tree):
    """Runs of one character and of short periods, of different lengths, phases and surroundings."""
    r = random.Random(seed)
    words = ["a", "ab", "abc", "abcdefg", "abcabd", "xyzxyzw"]
    piece = lambda: rotated(r.choice(words), r.randint(1, 90), r.randint(0, 6))
    docs = [(i, "".join(r.choice([piece(), piece(), "".join(r.choice("pqrst") for _ in range(r.randint(1, 25)))]) for _ in range(r.randint(1, 7)))) for i in range(24)]
    assert sorted(map(tuple, S.shared_spans(frame(spark, docs), 24, in_tree).collect())) == brute(docs, 24)


@pytest.mark.parametrize("word", ["a", "ab", "abcdef", "abcdefghijklmnopqrstuvwxy" * 2, "0123456789" * 7])
def test_few_suffixes_are_chosen(word):
    import numpy as np

    text = rotated(word, 60_000)
    places, _ = S.chosen(S._codes(text), np.array([len(text)]), 200)
    assert 1 <= len(places) <= len(text) / 25


def test_random_trees():
    """The ranges of a tree are those of comparing every span."""
    for seed in range(200):
        r = random.Random(seed)
        length = 8
        texts, lefts, low, high = [], [], [], []
        for _ in range(r.randint(2, 9)):
            x = r.randint(0, 4)
            texts.append("".join(r.choice("ab") for _ in range(x)) + "aabb" + "".join(r.choice("ab") for _ in range(r.randint(max(0, 4 - x), 4))))
            lefts.append(x)
            low.append(r.randint(1, 3))
            high.append(low[-1] if r.random() < 0.8 else low[-1] + 1)
        least = r.choice([0, 4, 6, 8])
        got = S.subtree_repeats(texts, lefts, low, high, length, least)
        if all(a < b for a, b in zip(low, high)):
            continue
        for i, t in enumerate(texts):
            want = set()
            for at in range(lefts[i] + 1):
                if at + length > len(t) or at + length - lefts[i] < least:
                    continue
                docs = set()
                for j, u in enumerate(texts):
                    other = lefts[j] - (lefts[i] - at)
                    if other >= 0 and u[other : other + length] == t[at : at + length]:
                        docs |= {low[j], high[j]}
                if len(docs) > 1:
                    want.add(at)
            assert {x for a, b in got[i] for x in range(a, b + 1)} == want, (seed, i)
