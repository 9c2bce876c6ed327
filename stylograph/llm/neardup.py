"""Problem 5: near-duplicate records with small edits, by min-max hashing.

Two records are alike when the number of words in both is at least `threshold` times the number of words in one of
the two (so a record contained in a longer one counts). Words are the different longest runs of letters and
digits, ignoring case; records with fewer than `least_words` are no cases.

1. Records with the same words form one class; only its smallest identifier goes on.
2. Under each permutation both the minimum and the maximum of the words' hashes are kept: one hash evaluation for two unbiased
   signature values. Each of `bands` values is the key of a band; a sketch of the words (a bit for each word) goes along.
3. Classes that share a band are candidates. A band of up to `most_in_band` classes is compared all against all; the sketches bound
   the overlap of two classes from above, and only what can pass goes on.
4. The classes of larger bands, whose value is that of a frequent word, are compared with each other exactly, so that the size of a band drops
   nothing: they are dealt out to blocks, and every pair of blocks is a task. Words are told apart by 16-bit codes, which can only raise an
   overlap. A class that has `least` of its n words in another has `some` of any n - least + some of its words there; the rarest are taken, and
   bitmaps by word count them in 64 classes at once. What is left is counted code by code.
5. Each candidate pair counts once; the few left are compared exactly, word by word.

Pairs of the classes in step 4 are all found. Of others, an alike pair is missed with a probability that falls with its Jaccard similarity. The work of
step 4 grows as the square of its classes, as does the number of pairs that are alike by chance (both measured in the README).

Defined results: null and empty texts are no cases; rows with a null identifier are none; repeated rows of one identifier
count once (of different texts of one identifier each counts for it); further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograph.functions.canon import digest, word_runs
from stylograph.plans.scale import cut, skew_join, split_hot, stage

THRESHOLD = 0.7
LEAST_WORDS = 8
BANDS = 16
MOST_IN_BAND = 600
#: Classes that the exact way indexes at once; a block has up to IN_BLOCK times as many. Both have their bound of words, too.
MOST_IN_TASK, IN_BLOCK, MOST_WORDS = 100_000, 4, 3_000_000
#: Values of a word's code; share of the classes that codes with a bitmap in common have; words of a bitmap times classes that are looked up at once.
CODES, SHARE, AT_ONCE = 1 << 16, 1 / 128, 1 << 14
#: Pairs of blocks for each core, where there are classes enough, and classes that are enough for a block.
PER_CORE, LEAST_IN_BLOCK = 3, 2000
#: 64-bit words of the sketch, and its seed.
WIDTH, SKETCH_SEED = 4, 0x1D8E4E27C47D124F
#: Groups up to this size are compared together, larger ones as a matrix each, of so many rows at a time.
SMALL, ROWS = 16, 256
#: Candidate pairs of a batch that leaves a task, and rows of bands that are compared at a time.
IN_BATCH, HELD = 100_000, 20_000
#: Records of a class of copies that one task writes out pairs of.
MOST_COPIES = 1000

_LONGS = ("band", "rep", *(f"s{i}" for i in range(WIDTH)))
_SCHEMA = ", ".join(f"{c} bigint" for c in _LONGS) + ", n int"
_PAIRS = "rep_a bigint, rep_b bigint"


def _hashed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def min_max(words: np.ndarray, ends: np.ndarray, values: int, first: int = 0) -> np.ndarray:
    """`values` signature values, one row per set: `words` are the hashed words of sets that end at `ends`, none empty. Column 2k is the
    minimum under permutation `first` + k, column 2k + 1 its maximum."""
    begins = np.concatenate([[0], ends[:-1]])
    out = np.empty((len(ends), values), np.uint64)
    for k in range(0, values, 2):
        h = _hashed(words, (first + k // 2 + 1) * 0xA0761D6478BD642F % (1 << 64))
        out[:, k] = np.minimum.reduceat(h, begins)
        if k + 1 < values:
            out[:, k + 1] = np.maximum.reduceat(h, begins)
    return out


def sketches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """WIDTH 64-bit words per set, with a bit set for each member; one bit is never set, so that common bits fit a byte."""
    begins = np.concatenate([[0], ends[:-1]])
    h = _hashed(words, SKETCH_SEED)
    bit = np.uint64(1) << (h >> np.uint64(58))
    which = (h & np.uint64(0xFFFFFF)) % np.uint64(WIDTH)
    bit[(which == np.uint64(0)) & (bit == np.uint64(1))] = 0
    return np.stack([np.bitwise_or.reduceat(np.where(which == np.uint64(i), bit, np.uint64(0)), begins) for i in range(WIDTH)], axis=1)


def _flat(column: pa.ListArray, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(kind), offsets[1:] - offsets[0]


def _banded(bands: int):
    """Rows of the bands of classes (rep, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                words, ends = _flat(batch.column("words"))
                band = min_max(words, ends, bands) ^ np.arange(bands, dtype=np.uint64)[None, :]
                columns = [_hashed(band, 0x589965CC75374CC3), np.repeat(batch.column("rep").to_numpy(), bands), *(np.repeat(s, bands) for s in sketches(words, ends).T)]
                size = np.repeat(np.diff(ends, prepend=0).astype(np.int32), bands)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c).reshape(-1).view(np.int64)) for c in columns), pa.array(size)], names=[*_LONGS, "n"])

    return run


def _found(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches (rep_a, rep_b), rep_a the smaller, of a stream of pairs, of which only a batch is held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def batches() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*held))
        low, high = np.minimum(a, b), np.maximum(a, b)
        for at in range(0, len(a), IN_BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(low[at : at + IN_BATCH]), pa.array(high[at : at + IN_BATCH])], names=["rep_a", "rep_b"])

    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size >= IN_BATCH:
            yield from batches()
            held, size = [], 0
    if size:
        yield from batches()


class Group:
    """Rows of one or more whole bands, to be compared."""

    def __init__(self, columns: dict[str, np.ndarray], threshold: float):
        self.rep, self.n = columns["rep"], columns["n"]
        self.bits = np.stack([columns[f"s{i}"] for i in range(WIDTH)]).view(np.uint64)
        self.spare = self.n - np.bitwise_count(self.bits).sum(0, dtype=np.int32)  # words without a bit of their own
        self.need = np.ceil(self.n * threshold - 1e-9).astype(np.int32)

    def among(self, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may pass among the rows `order`[start : start + size] of each group."""
        small = sizes <= SMALL
        at = np.repeat(starts[small], sizes[small])
        if len(at):
            place = np.arange(len(at)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
            left = np.repeat(sizes[small], sizes[small]) - place - 1
            at = at + place
            for k in range(1, int(sizes[small].max())):
                keep = left >= k
                at, left = at[keep], left[keep]
                yield self._tested(order[at], order[at + k])
        for start, size in zip(starts[~small], sizes[~small]):
            yield from self._matrix(order[start : start + size])

    def _tested(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = np.bitwise_count(self.bits[0, a] & self.bits[0, b])
        for s in self.bits[1:]:
            common += np.bitwise_count(s[a] & s[b])
        return self._passed(a, b, common)

    def _matrix(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = rows[np.argsort(self.n[rows], kind="stable")]  # so the row of a cell is the smaller set
        bits = self.bits[:, rows]
        least = np.clip(self.need[rows] - self.spare[rows], 0, 255).astype(np.uint8)
        for at in range(0, len(rows), ROWS):
            to = min(len(rows), at + ROWS)
            common = np.bitwise_count(bits[0, at:to, None] & bits[0, None, at:])
            for s in bits[1:]:
                common += np.bitwise_count(s[at:to, None] & s[None, at:])
            i, j = np.nonzero(common >= least[at:to, None])
            later = j > i
            i, j = i[later], j[later]
            yield self._passed(rows[at + i], rows[at + j], common[i, j])

    def _passed(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = common + np.minimum(self.spare[a], self.spare[b]) >= np.minimum(self.need[a], self.need[b])
        return a[ok], b[ok]


def _compared(threshold: float):
    """Candidate pairs of rows sorted by band, all bands small enough to be compared all against all."""

    def pairs(c: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group = Group(c, threshold)
        begins = np.flatnonzero(np.concatenate([[True], c["band"][1:] != c["band"][:-1]]))
        for a, b in group.among(np.arange(len(c["band"])), begins, np.diff(np.append(begins, len(c["band"])))):
            other = c["rep"][a] != c["rep"][b]
            yield c["rep"][a[other]], c["rep"][b[other]]

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({x: batch.column(x).to_numpy() for x in (*_LONGS, "n")})
            size += batch.num_rows
            if size >= HELD:
                whole = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
                open_at = int(np.searchsorted(whole["band"], whole["band"][-1]))
                if open_at:
                    yield from pairs({k: v[:open_at] for k, v in whole.items()})
                held, size = [{k: v[open_at:] for k, v in whole.items()}], size - open_at
        if held:
            yield from pairs({k: np.concatenate([x[k] for x in held]) for k in held[0]})

    return lambda batches: _found(every(batches))


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ..., begin + size - 1 of each in turn."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Coded:
    """Classes in the order of their sizes, with the codes of their words one after another."""

    def __init__(self, rep: np.ndarray, n: np.ndarray, codes: np.ndarray):
        order = np.argsort(n, kind="stable")
        self.rep, self.n = rep[order], n[order]
        self.codes = codes[_spread((np.cumsum(n) - n)[order], self.n)]
        self.begins, self.first = np.concatenate([[0], np.cumsum(self.n)]), 0

    def parts(self, most: int) -> Iterator[Coded]:
        """Successive parts of up to `most` classes and about MOST_WORDS words."""
        which = np.maximum.accumulate(np.maximum(np.arange(len(self.n)) // most, self.begins[:-1] // MOST_WORDS) if len(self.n) else self.n)
        for at in np.split(np.arange(len(self.n)), np.flatnonzero(np.diff(which)) + 1):
            part = object.__new__(Coded)
            part.rep, part.n, part.begins = self.rep[at], self.n[at], self.begins[at[0] : at[-1] + 2] - self.begins[at[0]]
            part.codes, part.first = self.codes[self.begins[at[0]] : self.begins[at[-1] + 1]], int(at[0])
            yield part


def _task(low, high, blocks: int):
    """Number of a pair of blocks, low <= high: 0 and on, without gaps."""
    return low * (2 * blocks + 1 - low) / 2 + high - low


class Bitmaps:
    """For each code the classes that have it, a bit each. Rare codes have a bitmap in common, so that there are few."""

    def __init__(self, classes: Coded):
        count = np.bincount(classes.codes, minlength=CODES)
        order = np.argsort(count, kind="stable")
        kind = ((np.cumsum(count[order]) - count[order]) // max(1, int(len(classes.n) * SHARE))).astype(np.int64)
        self.row = np.empty(CODES, np.int64)
        self.row[order] = np.cumsum(np.diff(kind, prepend=kind[0]) > 0)
        self.count = np.bincount(self.row, weights=count)
        width = (len(classes.n) + 63) // 64
        self.bits = np.zeros((len(self.count), width), np.uint64)
        of = np.repeat(np.arange(len(classes.n)), classes.n)
        at = self.row[classes.codes] * width + (of >> 6)
        order = np.argsort(at, kind="stable")
        at, bit = at[order], np.uint64(1) << (of[order] & 63).astype(np.uint64)
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        self.bits.reshape(-1)[at[begins]] = np.bitwise_or.reduceat(bit, begins)

    def several(self, rows: np.ndarray, first: int, some: int) -> np.ndarray:
        """A bitmap for each of `rows`, from word `first`: the classes in at least `some` (1, 2 or 4) of its bitmaps. Counted by full adders."""
        bits = self.bits[:, first:]
        ones, twos, fours = (np.zeros((len(rows), bits.shape[1]), np.uint64) for _ in range(3))
        none = np.zeros_like(ones)

        def added(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u, carry = x ^ y, x & y
            carry |= u & z
            u ^= z
            return u, carry

        for at in range(0, rows.shape[1], 4):
            x = [bits[rows[:, k]] if k < rows.shape[1] else none for k in range(at, at + 4)]
            ones, low = added(ones, x[0], x[1])
            ones, high = added(ones, x[2], x[3])
            twos, carry = added(twos, low, high)
            fours |= carry
        return fours | twos | ones if some == 1 else fours | twos if some == 2 else fours


def _overlaps(a: Coded, b: Coded, threshold: float, ties: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of a class of `a` with a larger one of `b` (with `ties`, or one as large) that has the share `threshold` of its words;
    if both are the same classes, each pair once."""
    for part in b.parts(most):
        index = Bitmaps(part)
        edges = np.flatnonzero(np.diff(a.n, prepend=-1, append=-1))
        for begin, end in zip(edges[:-1], edges[1:]):
            n = int(a.n[begin])
            start = int(np.searchsorted(part.n, n, "left" if ties else "right"))
            if start == len(part.n):
                continue
            least, first = int(np.ceil(n * threshold - 1e-9)), start >> 6
            some = 4 if least >= 4 else 2 if least >= 2 else 1
            step = min(64, max(1, AT_ONCE // (index.bits.shape[1] - first)))
            for at in range(begin, end, step):
                to = min(end, at + step)
                codes = a.codes[a.begins[at] : a.begins[to]].reshape(to - at, n)
                rows, chosen = index.row[codes], n - least + some
                if chosen < n:
                    rows = np.take_along_axis(rows, np.argpartition(index.count[rows], chosen - 1, axis=1)[:, :chosen], axis=1)
                several = index.several(rows, first, some)
                k, word = np.nonzero(several)
                x, bit = np.nonzero(np.unpackbits(several[k, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                k, of = k[x], (word[x] + first) * 64 + bit
                later = of + part.first > at + k if a is b else of >= start
                k, of = k[later], of[later]
                marked = np.zeros((to - at, CODES), bool)
                marked[np.arange(to - at)[:, None], codes] = True
                size = part.n[of]
                for some_of in np.split(np.arange(len(k)), np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE // 64)) + 1):
                    if len(some_of):
                        x, y, length = k[some_of], of[some_of], size[some_of]
                        both = np.add.reduceat(marked[np.repeat(x, length), part.codes[_spread(part.begins[y], length)]], np.cumsum(length) - length, dtype=np.int64)
                        yield a.rep[at + x[both >= least]], part.rep[y[both >= least]]


def _exact(threshold: float, most: int, blocks: int):
    """Candidate pairs of the classes (rep, block, codes, task) of a pair of blocks, or of one with itself: all whose overlap suffices, and a few more."""
    same = {_task(x, x, blocks) for x in range(blocks)}

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = []
        for batch in batches:
            if batch.num_rows:
                codes, ends = _flat(batch.column("codes"), np.uint16)
                held.append((*(batch.column(c).to_numpy() for c in ("task", "block", "rep")), np.diff(ends, prepend=0).astype(np.int64), codes))
        if not held:
            return
        task, block, rep, n, codes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        for t in np.unique(task):  # one, unless partitions were put together
            own = [(task == t) & (block == x) for x in np.unique(block[task == t])]
            parts = [Coded(rep[x], n[x], codes[np.repeat(x, n)]) for x in own]
            if len(parts) == 2:
                yield from _overlaps(parts[0], parts[1], threshold, True, most)
                yield from _overlaps(parts[1], parts[0], threshold, False, most)
            elif t in same:
                for a, b in _overlaps(parts[0], parts[0], threshold, True, most):
                    yield a[a != b], b[a != b]  # classes of one identifier are no pair

    return lambda batches: _found(every(batches))


class NearDuplicates:
    """Classes of equal word sets, their members, and the links between alike classes."""

    def __init__(self, df: DataFrame, id_col: str = "pos", text_col: str = "text", threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, bands: int = BANDS, most_in_band: int = MOST_IN_BAND, most_in_task: int = MOST_IN_TASK):
        if not 0.5 < threshold <= 1:
            raise ValueError("threshold must be above 0.5 and at most 1")
        self.threshold = threshold
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.array(F.array_sort(F.array_distinct(word_runs(F.col(text_col)))))).alias("words"))  # an explode: words are cut once
        rows = rows.where(F.col("id").isNotNull() & (F.size("words") >= least_words))
        self.rows = stage(rows.select("id", digest(F.array_join("words", " ")).alias("key"), F.transform("words", lambda w: F.xxhash64(w)).alias("words")))
        first = self.rows.groupBy("key").agg(F.min(F.struct("id", "words")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
        self.classes = stage(first.select("key", F.col("first.id").alias("rep"), "n_copies", F.col("first.words").alias("words")))
        self.links = stage(self._links(bands, most_in_band, most_in_task))

    def _candidates(self, bands: int, most_in_band: int, most_in_task: int) -> DataFrame:
        rows = self.classes.select("rep", "words").mapInArrow(_banded(bands), _SCHEMA)
        large = stage(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_in_band).select("band"))
        of_large, others = split_hot(rows, large, ["band"])
        pairs = others.repartition("band").sortWithinPartitions("band", "rep").mapInArrow(_compared(self.threshold), _PAIRS)
        rest = stage(self.classes.select("rep", "words").join(of_large.select("rep").distinct(), "rep", "left_semi").select("rep", F.transform("words", lambda w: F.shiftright(w, 48).cast("smallint")).alias("codes")))
        classes, words = rest.agg(F.count(F.lit(1)), F.sum(F.size("codes").cast("bigint"))).first()
        return (pairs.unionByName(self._of_blocks(rest, classes, words, most_in_task)) if classes else pairs).distinct()

    def _of_blocks(self, rest: DataFrame, classes: int, words: int, most_in_task: int) -> DataFrame:
        """Candidates among `rest` (rep, codes): each pair of blocks is a partition."""
        for_cores = math.isqrt(2 * PER_CORE * rest.sparkSession.sparkContext.defaultParallelism)
        blocks = max(-(-classes // (IN_BLOCK * most_in_task)), -(-words // (IN_BLOCK * MOST_WORDS)), min(for_cores, -(-classes // LEAST_IN_BLOCK)))
        own, other = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        rows = rest.withColumn("block", own).withColumn("other", other)
        task = _task(F.least("block", "other"), F.greatest("block", "other"), blocks).cast("int")
        return rows.select("rep", "block", "codes", task.alias("task")).repartitionById(blocks * (blocks + 1) // 2, "task").mapInArrow(_exact(self.threshold, most_in_task, blocks), _PAIRS)

    def _links(self, bands: int, most_in_band: int, most_in_task: int) -> DataFrame:
        pairs = self._candidates(bands, most_in_band, most_in_task)
        a = self.classes.select(F.col("rep").alias("rep_a"), F.col("words").alias("words_a"))
        b = self.classes.select(F.col("rep").alias("rep_b"), F.col("words").alias("words_b"))
        both = F.size(F.array_intersect("words_a", "words_b"))
        enough = both >= F.lit(self.threshold) * F.least(F.size("words_a"), F.size("words_b")) - 1e-9
        links = pairs.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", both.alias("n_both"), enough.alias("enough"))
        return links.where("enough").groupBy("rep_a", "rep_b").agg(F.max("n_both").alias("n_both"))

    def members(self) -> DataFrame:
        """(id, rep, n_copies) of every record with enough words."""
        counts = self.classes.select("key", F.col("n_copies").alias("n"))
        return skew_join(self.rows.select("id", "key"), self.classes.select("key", "rep", "n_copies"), ["key"], counts, self.rows.count()).select("id", "rep", "n_copies").distinct()

    def pairs(self) -> DataFrame:
        """(pos_a, pos_b): every pair of alike records, copies written out, as its size is the result's own.

        Records of a class are dealt out over salts, so that a class of many copies is written out by many tasks.
        """
        copied = self.classes.where("n_copies > 1").select("rep", F.ceil(F.col("n_copies") / F.lit(MOST_COPIES)).cast("int").alias("salts"))
        a, b = (copied.select(F.col("rep").alias(f"rep_{x}"), F.col("salts").alias(f"salts_{x}")) for x in "ab")
        links = self.links.select("rep_a", "rep_b").join(a, "rep_a", "left").join(b, "rep_b", "left")
        single = links.where("salts_a IS NULL AND salts_b IS NULL").select(F.col("rep_a").alias("pos_a"), F.col("rep_b").alias("pos_b"))
        links = links.where("salts_a IS NOT NULL OR salts_b IS NOT NULL").withColumns({"salts_a": F.coalesce("salts_a", F.lit(1)), "salts_b": F.coalesce("salts_b", F.lit(1))})
        links = links.unionByName(copied.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.col("salts").alias("salts_a"), F.col("salts").alias("salts_b")))
        links = links.withColumn("at_a", F.explode(F.sequence(F.lit(0), F.col("salts_a") - 1))).withColumn("at_b", F.explode(F.sequence(F.lit(0), F.col("salts_b") - 1)))
        member = self.members().select("id", "rep", F.pmod(F.xxhash64("id"), F.ceil(F.col("n_copies") / F.lit(MOST_COPIES))).cast("int").alias("at"))
        a, b = (member.select(F.col("id").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab")
        rows = links.join(a, ["rep_a", "at_a"]).join(b, ["rep_b", "at_b"]).where("(rep_a <> rep_b AND a <> b) OR a < b")
        return single.unionByName(rows.select(F.least("a", "b").alias("pos_a"), F.greatest("a", "b").alias("pos_b"))).distinct()

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, n_copies, n_links) of every record with enough words: its class of equal word sets, the
        connected group of alike classes (both by smallest identifier), and the links of its class to others."""
        links = self.links.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y"))
        ends = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        degrees = ends.groupBy("x").agg(F.count(F.lit(1)).alias("n_links"))
        per_class = self.classes.select("key", "rep", "n_copies").join(degrees.withColumnRenamed("x", "rep"), "rep", "left").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
        per_class = stage(per_class.select("key", "rep", F.coalesce("label", "rep").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
        counts = per_class.select("key", F.col("n_copies").alias("n"))
        found = skew_join(self.rows.select("id", "key"), per_class, ["key"], counts, self.rows.count())
        return found.select("id", F.col("rep").alias("class_id"), "group_id", "n_copies", "n_links").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node of the connected component of each node of `edges` (x, y).

    Alternating large-star and small-star rounds; each is one shuffle of at most as many edges as before, and their
    number grows with the logarithm of the nodes. Nothing is collected. RuntimeError if `most_rounds` were not enough.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(rows: DataFrame, own: bool) -> DataFrame:
        """`rows` with the smallest neighbour `m` of u; a hub is no hot spot."""
        least = F.min("v")
        found = stage(rows.groupBy("u").agg((F.least(least, F.col("u")) if own else least).alias("m"), F.count(F.lit(1)).alias("n")))
        return skew_join(rows, found.select("u", "m"), ["u"], found.select("u", "n"), 2 * before[0])

    edges = cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_least(large, False)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
