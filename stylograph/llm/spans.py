"""Problem 8: long passages that documents share word for word, by prefix-partitioned suffix trees, made sparse.

A character of a document is shared if it lies in a span of at least `length` characters that also appears in a
document with another identifier.

1. Of all suffixes, those are chosen that start at a window minimum of the hashes of K characters (K about half of
   `length`). Equal spans choose equal suffixes, so each shared span holds a chosen suffix at the same place in both documents, yet
   only about one suffix in fifty is chosen. In a periodic run the minimum comes again each period; there the first two, the last two
   and one about every K / 2 are chosen. Two runs of the same period match wherever they are laid over each other, so these
   are enough, and no text has more than about one chosen suffix in 25.
2. Suffixes are partitioned by their first K characters (hashed). A partition of one document is dropped. For
   the others the characters around are fetched; equal surroundings count once from here on.
3. A partition that fits into memory gets its tree: its suffixes sorted, with the longest common prefixes of neighbours, whose
   intervals are the internal nodes. At a node of depth d all suffixes agree on d characters; sorted by what stands before
   them, neighbours of different documents give how far to the left each is repeated, too. Together these are the maximal repeats,
   and those of `length` or more are kept.
4. A partition that does not fit is divided by longer prefixes, step by step, until its parts fit. What a longer prefix
   parts, repeats with less than that to the right of the place, is found before by grouping whole spans of `length`.
5. Repeats are carried back to every document and joined to longest runs.

No hash decides equality of texts within a tree: characters are compared. Prefixes, surroundings and whole spans are told apart
by 16 bytes of BLAKE2.

Defined results: null, empty and short texts share nothing; a span repeated within one identifier only is not
shared; rows with a null identifier are left out; repeated rows of an identifier give one set of runs if their texts
are equal; offsets count code points; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stylograph.plans.scale import skew_join, stage

LENGTH = 200
#: Different surroundings in a partition that gets a tree (some 300 characters each); more get longer prefixes.
MOST_IN_TREE = 20_000
#: Steps by which prefixes grow from K to `length`.
STEPS = 4
#: Code points hashed at a time; a longer text is hashed in overlapping parts.
PART = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """`op` (minimum or maximum) over each window of `width` items."""
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return op(a[:-rest], a[rest:]) if rest else a


def chosen(codes: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen suffixes in `codes` (texts one after another, up to `ends`), and the hashes of their first K characters."""
    k = length // 2
    width = length - k + 1
    n = len(codes)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64, out=sums[1:])
    grams = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1]) | np.uint64(1)
    least = _slide(grams, width, np.minimum)  # by start of a span of `length`
    starts = np.arange(len(least))
    end_of = ends[np.searchsorted(ends, starts, side="right")]
    least[starts + length > end_of] = 0  # the span would leave its text
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.nonzero(_slide(padded, width, np.maximum) == grams)[0]
    places = _thinned(places, grams[places], ends, k // 2)
    return places, grams[places]


def _thinned(places: np.ndarray, grams: np.ndarray, ends: np.ndarray, apart: int) -> np.ndarray:
    """`places` without most of those in periodic runs: equal minima at equal distances of `apart` or less, in one text."""
    if len(places) < 5:
        return places
    step = np.diff(places)
    again = (grams[1:] == grams[:-1]) & (step <= apart) & (np.diff(np.searchsorted(ends, places, side="right")) == 0)
    same = np.concatenate([[False], again[1:] & again[:-1] & (step[1:] == step[:-1]), [False]])  # as far from the one before as from the next
    run_of = np.cumsum(~same) - 1  # a run is a place that begins one and those that go on like it
    first = np.flatnonzero(~same)
    number = np.arange(len(places)) - first[run_of]  # 0 begins a run
    size = np.bincount(run_of)[run_of]
    every = np.maximum(1, apart // np.maximum(1, np.concatenate([step, [1]])))
    return places[~same | (number <= 1) | (number >= size - 1) | (number % every == 0)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _parts(ids: list, texts: list[str], length: int) -> Iterator[tuple[list, list[int], list[str]]]:
    """Texts (identifier, offset, text) in lots of about PART characters; long texts in parts that overlap by length - 1."""
    lot: tuple[list, list, list] = ([], [], [])
    size = 0
    for doc, text in zip(ids, texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, PART):
            piece = text[at : at + PART + length - 1]
            for x, y in zip(lot, (doc, at, piece)):
                x.append(y)
            size += len(piece)
            if size >= PART:
                yield lot
                lot, size = ([], [], []), 0
    if lot[0]:
        yield lot


def _suffixes(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for docs, offsets, pieces in _parts(batch["doc_id"].tolist(), batch["text"].tolist(), length):
                codes = _codes("".join(pieces))
                ends = np.cumsum([len(p) for p in pieces])
                places, grams = chosen(codes, ends, length)
                which = np.searchsorted(ends, places, side="right")
                begins = ends - [len(p) for p in pieces]
                place = places - begins[which] + np.array(offsets, dtype=np.int64)[which]
                yield pd.DataFrame({"doc_id": np.array(docs, dtype=np.int64)[which], "place": place, "prefix": grams.view(np.int64)})

    return run


def _surroundings(length: int):
    k = length // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, hits in zip(batch["doc_id"], batch["text"], batch["hits"]):
                for hit in hits:
                    place = hit["place"]
                    left = min(place, length - k)
                    around = text[place - left : place + length]
                    key = hashlib.blake2b(around.encode("utf-8", "surrogatepass"), digest_size=16, key=left.to_bytes(4, "little")).digest()
                    out.append((doc, place, hit["prefix"], key, left, around))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["doc_id", "place", "prefix", "around_id", "left", "around"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "place", "prefix", "around_id", "left", "around"])

    return run


def _common(a: str, b: str, most: int) -> int:
    """Length of the common prefix of two texts, up to `most`."""
    if a[:most] == b[:most]:
        return min(most, len(a), len(b))
    low, high = 0, min(most, len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def nodes_of(common: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """Internal nodes (first, last, depth, depth of the parent) of the tree of sorted suffixes, from the common prefixes of neighbours;
    without those of a depth below `least`. The parent's depth is at least `least` - 1."""
    open_nodes: list[tuple[int, int]] = []  # (first, depth), deeper ones later
    for i, depth in enumerate([*common, -1]):
        first = i
        while open_nodes and open_nodes[-1][1] > depth:
            first, own = open_nodes.pop()
            parent = max(depth, open_nodes[-1][1] if open_nodes else -1)
            if own >= least:
                yield first, i, own, max(parent, least - 1)
        if not open_nodes or open_nodes[-1][1] < depth:
            open_nodes.append((first, depth))


def subtree_repeats(arounds: list[str], lefts: list[int], low: list[int], high: list[int], length: int, least: int = 0) -> list[list[tuple[int, int]]]:
    """For each surrounding of one partition the ranges (first, last) of starts in it whose `length` characters two documents share.

    `low` and `high` are the smallest and largest document of each surrounding; the chosen place is at `lefts`. Only repeats with
    `least` characters or more from the chosen place on are looked for.
    """
    ranges: list[list[tuple[int, int]]] = [[] for _ in arounds]
    if all(a < b for a, b in zip(low, high)):
        return [[(0, len(t) - length)] for t in arounds]
    after = [t[x:] for t, x in zip(arounds, lefts)]
    before = [t[:x][::-1] for t, x in zip(arounds, lefts)]
    order = sorted(range(len(arounds)), key=after.__getitem__)
    common = [_common(after[i], after[j], length) for i, j in zip(order, order[1:])]

    def mark(i: int, far: int, depth: int, parent: int) -> None:
        """Starts of surrounding `i` that are `far` or less before the place and whose span ends within `depth` but not within `parent` after it."""
        first, last = max(0, length - depth), min(far, length - parent - 1, lefts[i])
        if first <= last:
            ranges[i].append((lefts[i] - last, lefts[i] - first))

    for i, text in enumerate(after):  # what is shared as it is
        if low[i] < high[i]:
            mark(i, lefts[i], len(text), least - 1)
    by_left = sorted(range(len(arounds)), key=before.__getitem__)
    place = {i: r for r, i in enumerate(by_left)}
    left_common = [_common(before[i], before[j], length) for i, j in zip(by_left, by_left[1:])]
    for first, last, depth, parent in nodes_of(common, max(1, least)):
        members = order[first : last + 1]
        if min(low[i] for i in members) == max(high[i] for i in members):
            continue
        members.sort(key=place.__getitem__)
        if len(members) == len(arounds):
            shared = left_common
        else:
            shared = [_common(before[i], before[j], length) for i, j in zip(members, members[1:])]
        best = [-1] * len(members)
        for way in (range(len(members)), range(len(members) - 1, -1, -1)):
            near: list[tuple[int, int, int]] = []  # up to two (document or -1 for several, common with the current one), of different documents
            previous = -1
            for m in way:
                if previous >= 0:
                    c = shared[min(m, previous)]
                    near = [(d, min(x, c)) for d, x in near]
                i = members[m]
                own = low[i] if low[i] == high[i] else -1
                for d, x in near:
                    if d != own or d == -1:
                        best[m] = max(best[m], x)
                near = [(own, length), *[(d, x) for d, x in near if d != own][:1]]
                previous = m
        for m, i in enumerate(members):
            if best[m] >= 0:
                mark(i, best[m], depth, parent)
    return ranges


def _subtrees(length: int):
    columns = ["around_id", "first", "last"]

    def solve(rows: list[tuple]) -> list[tuple]:
        found = subtree_repeats([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], length, rows[0][6])
        return [(r[1], a - r[3], b - r[3]) for r, ranges in zip(rows, found) for a, b in ranges]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []  # the batches are sorted by prefix
        for batch in batches:
            out: list[tuple] = []
            for row in batch[["prefix", "around_id", "around", "left", "low", "high", "reach"]].itertuples(index=False, name=None):
                if group and row[0] != group[0][0]:
                    out += solve(group)
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=columns)
        if group:
            yield pd.DataFrame(solve(group), columns=columns)

    return run


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _whole_spans(length: int, reach: int, further: int):
    """Rows (around_id, first, node, low, high) of the spans that end from `reach` to `further` - 1 characters after the chosen place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 500):
                rows = [
                    (r.around_id, end - length, _digest(r.around[r.left + end - length : r.left + end]), r.low, r.high)
                    for r in batch.iloc[part : part + 500].itertuples(index=False)
                    for end in range(max(reach, length - r.left), min(further, len(r.around) - r.left + 1))
                ]
                yield pd.DataFrame(rows, columns=["around_id", "first", "node", "low", "high"])

    return run


def _longer_prefixes(reach: int):
    """The rows with the prefix of `reach` characters; what has fewer shares no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["around"].str.len() - batch["left"] >= reach].copy()
            batch["prefix"] = [int.from_bytes(_digest(t[x : x + reach])[:8], "little", signed=True) for t, x in zip(batch["around"], batch["left"])]
            batch["reach"] = reach
            yield batch

    return run


def shared_spans(docs: DataFrame, length: int = LENGTH, most_in_tree: int = MOST_IN_TREE) -> DataFrame:
    """(doc_id, span_start, span_end): the longest runs of shared characters of each document."""
    if length < 2:
        raise ValueError("length must be 2 or more")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    suffixes = stage(texts.mapInPandas(_suffixes(length), "doc_id bigint, place bigint, prefix bigint"))
    prefixes = stage(suffixes.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high"))
    hits = skew_join(suffixes, prefixes.select("prefix"), ["prefix"], prefixes, suffixes.count(), "left_semi")
    hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("place", "prefix")).alias("hits"))  # bounded by the document itself
    schema = "doc_id bigint, place bigint, prefix bigint, around_id binary, left int, around string"
    found = stage(texts.join(hits, "doc_id").mapInPandas(_surroundings(length), schema))

    arounds = found.groupBy("prefix", "around_id").agg(F.max("around").alias("around"), F.max("left").alias("left"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    arounds = stage(arounds)
    k = length // 2
    lengths = [k + (length - k) * i // STEPS for i in range(STEPS + 1)]
    columns = ("prefix", "around_id", "around", "left", "low", "high", "reach")
    rows, repeats = arounds.withColumn("reach", F.lit(k)).select(*columns), []
    for reach, further in zip(lengths, lengths[1:]):
        sizes = stage(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")))
        large = sizes.where(F.col("n") > most_in_tree)
        any_large = bool(large.limit(1).count())
        small = rows.join(large.select("prefix"), "prefix", "left_anti") if any_large else rows
        repeats.append(small.repartition("prefix").sortWithinPartitions("prefix").mapInPandas(_subtrees(length), "around_id binary, first int, last int"))
        if not any_large:
            break
        deep = stage(skew_join(rows, large.select("prefix"), ["prefix"], sizes, rows.count(), "left_semi").select(*columns))
        spans = stage(deep.mapInPandas(_whole_spans(length, reach, further + (further == length)), "around_id binary, first int, node binary, low bigint, high bigint"))
        per_node = spans.groupBy("node").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count(F.lit(1)).alias("n"))
        shared = skew_join(spans, per_node.where("lo < hi").select("node"), ["node"], per_node, spans.count(), "left_semi")
        repeats.append(shared.select("around_id", "first", F.col("first").alias("last")))
        if further == length:
            break
        rows = stage(deep.mapInPandas(_longer_prefixes(further), deep.schema))
    every = repeats[0]
    for more in repeats[1:]:
        every = every.unionByName(more)
    every = stage(every)

    counts = arounds.groupBy("around_id").agg(F.sum("n").alias("n"))
    spans = skew_join(found.select("doc_id", "place", "around_id"), every, ["around_id"], counts, found.count())
    spans = spans.select("doc_id", (F.col("place") + F.col("first")).alias("s"), (F.col("place") + F.col("last") + length).alias("e"))
    return merge_spans(spans)


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): overlapping or touching spans (doc_id, s, e) joined."""
    before = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.withColumn("reach", F.max("e").over(before))
    rows = rows.withColumn("run", F.sum(F.when(F.col("reach") >= F.col("s"), 0).otherwise(1)).over(until))
    return rows.groupBy("doc_id", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("run")


def shared_amounts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document; the share of an empty text is 0."""
    per_doc = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared", F.lit(0)).cast("bigint")
    return rows.join(per_doc, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)).alias("shared_share"))
