import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stylograph.llm import neardup as N


def words(text):
    return frozenset(re.findall(r"[^\W_]+", (text or "").lower()))


def brute(rows):
    sets = [(p, words(t)) for p, t in rows if p is not None]
    out = set()
    for i, (p, a) in enumerate(sets):
        for q, b in sets[i + 1 :]:
            if p != q and min(len(a), len(b)) >= 8 and len(a & b) >= 0.7 * min(len(a), len(b)) - 1e-9:
                out.add((min(p, q), max(p, q)))
    return out


def made(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = r.sample(vocabulary, r.randint(9, 20))
        rows.append((10 * i, " ".join(base)))
        edited = [w if r.random() > 0.15 else r.choice(vocabulary) for w in base]
        r.shuffle(edited)
        rows.append((10 * i + 1, " ".join(edited) + "!" * r.randint(0, 2)))
        rows.append((10 * i + 2, " ".join(base).upper()))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, text string")


@pytest.mark.parametrize("most_in_band", [20_000, 3])
def test_pairs(spark, most_in_band):
    rows = [*made(), (9001, None), (9002, ""), (9003, "too few words here"), (None, made()[0][1])]
    got = [tuple(r) for r in N.NearDuplicates(frame(spark, rows), most_in_band=most_in_band).pairs().collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(set(got)) >= 0.97 * len(want)


def family(n, members, seed=5):
    """`members` edited versions of one post of 20 words, each with its own 3 words, among `n` classes of other words."""
    r = random.Random(seed)
    base = [f"base{i}" for i in range(20)]
    rows = []
    for i in range(members):
        kept = r.sample(base, 17)
        rows.append((i, " ".join([*kept, *(f"edit{i}x{j}" for j in range(3))])))
    return rows + [(1000 + i, " ".join(f"other{r.randrange(3000)}" for _ in range(20))) for i in range(n - members)]


@pytest.mark.parametrize("n, members, most_in_band", [(240, 80, 20_000), (240, 80, 30), (10, 4, 20_000), (24, 8, 20_000), (40, 14, 20_000)])
def test_a_family_of_a_third(spark, n, members, most_in_band):
    rows = family(n, members)
    got = [tuple(r) for r in N.NearDuplicates(frame(spark, rows), most_in_band=most_in_band).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("n", [10, 25, 40])
def test_small_tables(spark, n):
    rows = made(seed=n, n=60)[:n]
    assert {tuple(r) for r in N.NearDuplicates(frame(spark, rows)).pairs().collect()} == brute(rows)


def test_groups(spark):
    a, b, c = "one two three four five six seven eight", "one two three four five six seven nine", "one two three four five six eight nine ten"
    rows = [(1, a), (2, b), (3, c), (4, a.upper()), (5, "other words that are not like any of those above at all"), (6, "short")]
    got = {r.id: (r.class_id, r.group_id, r.n_copies, r.n_links) for r in N.NearDuplicates(frame(spark, rows)).groups().collect()}
    assert got[1] == (1, 1, 2, 2) and got[4] == (1, 1, 2, 2) and got[2][1] == 1 and got[3][1] == 1 and got[5] == (5, 5, 1, 0) and 6 not in got


def test_empty_repeats_and_clashes(spark):
    from pyspark.sql import functions as F

    assert N.NearDuplicates(frame(spark, [])).pairs().count() == 0 and N.NearDuplicates(frame(spark, [])).groups().count() == 0
    text = "one two three four five six seven eight"
    df = frame(spark, [(1, text), (1, text), (2, text)]).withColumns({"rep": F.lit(1), "words": F.lit("x"), "n": F.lit(2)})
    assert [tuple(r) for r in N.NearDuplicates(df).pairs().collect()] == [(1, 2)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in N.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {i: 100 for i in range(100, 141)}


def test_minimum_and_maximum_are_unbiased():
    rng = np.random.default_rng(3)
    share, n = [], 64
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, size=30).astype(np.uint64)
        a, b = pool[:24], pool[6:]
        keys = N.min_max(np.concatenate([a, b]), np.array([24, 48]), n)
        share.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(share) - 18 / 30) < 0.05


def test_large_bands_go_on_to_further_shuffles(spark):
    """Bands of more than a few classes leave their task; the links stay those of brute force, and each counts once."""
    rows = family(120, 40)
    got = [tuple(r) for r in N.NearDuplicates(frame(spark, rows), most_in_band=4, most_in_task=12).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_a_class_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_COPIES", 5)
    text = "one two three four five six seven eight"
    rows = [(i, text.upper() if i % 2 else text) for i in range(23)] + [(100 + i, "one two three four five six seven nine ten") for i in range(12)]
    got = [tuple(r) for r in N.NearDuplicates(frame(spark, rows)).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_long_texts(spark):
    words_of = [f"w{i}" for i in range(40_000)]
    rows = [(1, " ".join(words_of)), (2, " ".join(words_of[:29_000])), (3, " ".join(words_of[::-1])), (4, " ".join(f"v{i}" for i in range(40_000)))]
    assert {tuple(r) for r in N.NearDuplicates(frame(spark, rows)).pairs().collect()} == {(1, 2), (1, 3), (2, 3)}


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "x bigint, y bigint")
    with pytest.raises(RuntimeError, match="did not settle"):
        N.components(edges, most_rounds=1)


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(4)
    for size in (9, 40, 400, 4000):
        pool = rng.integers(0, 1 << 63, size=2 * size).astype(np.uint64)
        a, b = pool[:size], pool[size // 2 : size // 2 + size]
        bits = N.sketches(np.concatenate([a, b]), np.array([size, 2 * size]))
        n, common = np.bitwise_count(bits).sum(1), int(np.bitwise_count(bits[0] & bits[1]).sum())
        assert common <= 255 and common + min(size - n) >= size - size // 2


def test_large_bands_drop_nothing(spark):
    """Short posts in longer ones: few signature values agree, and all bands are larger than is compared all against all."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        base = r.sample(vocabulary, 30)
        rows.append((2 * i, " ".join(base)))
        rows.append((2 * i + 1, " ".join([*r.sample(base, 8), *r.sample(vocabulary, 3)])))
    got = [tuple(r) for r in N.NearDuplicates(frame(spark, rows), most_in_band=4, most_in_task=50).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("most", [100_000, 700])
def test_a_family_leaves_its_task_in_batches(most):
    """The pairs of a family go as the square of its members, so a task must not hold them together."""
    rng, n = np.random.default_rng(1), 2500
    base = rng.permutation(30_000)[:20]
    codes = [[*rng.permutation(base)[:17], *rng.integers(-30_000, 0, 3)] for _ in range(n)]
    none = pa.array(np.zeros(n, np.int32))
    rows = pa.RecordBatch.from_arrays([none, none, pa.array(np.arange(n)), pa.array(codes, pa.list_(pa.int16()))], names=["task", "block", "rep", "codes"])
    found = 0
    tracemalloc.start()
    try:
        for batch in N._exact(0.7, most, 1)(iter([rows])):
            assert batch.num_rows <= 100_000
            found += batch.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == n * (n - 1) // 2 and peak < 100e6
