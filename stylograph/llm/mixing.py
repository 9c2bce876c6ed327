"""Problem 7: mixing sources to target shares by weighted fair queueing.

Every use of a document gets a virtual finish time: the tokens of its source up to and including it, in a
seeded shuffle, divided by the source's share. The uses are ordered by that time over all sources and cut at the
total budget, so that at any prefix each source holds its share, up to one document.

Defined results: source names are compared trimmed and in lower case; documents of a source without target, with
a null source, or without tokens (null and empty texts) take no part; a target with a null or non-positive share
or repeat count takes no part; repeated rows of a target count once (largest share), as do those of a document (largest size); rows with a null
document identifier take no part. Shares are scaled to add up
to 1. Without a budget the largest total is taken for which no source needs more than its repeats. A use that
would exceed the budget ends the mix. Equal finish times are ordered by source, document and repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stylograph.plans.scale import cut, running_sums

#: Rows in a slice of the running sums, about; a slice is ordered within one task.
SLICE_ROWS = 50_000


def clean_source(source: Column) -> Column:
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def _targets(targets: DataFrame) -> DataFrame:
    rows = targets.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    rows = rows.where("source IS NOT NULL AND share > 0 AND share < double('inf') AND repeats > 0")
    return rows.groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats"))


def mix(docs: DataFrame, targets: DataFrame, n_tokens: Column, budget: int | None = None, seed: int = 17) -> DataFrame:
    """(place, doc_id, source, use, n_tokens, finish): the mix in its order; `use` counts a document's repeats from 1.

    `docs` has doc_id and source; `n_tokens` is its size column.
    """
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_source(F.col("source")).alias("source"), n_tokens.cast("bigint").alias("n_tokens"))
    target = _targets(targets)
    sized = sized.where("n_tokens > 0 AND source IS NOT NULL AND doc_id IS NOT NULL").join(F.broadcast(target.select("source")), "source", "left_semi")
    sized = cut(sized.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("s")).select("doc_id", "s.source", "s.n_tokens"))
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("docs")).join(target, "source").collect()
    share = {r.source: r.share for r in totals}
    whole = sum(share.values()) or 1.0
    most = min((int(r.total * r.repeats * whole / r.share) for r in totals), default=0)
    budget = most if budget is None else min(budget, most)
    n = sum(r.docs for r in totals)
    slices = max(1, n // SLICE_ROWS)
    facts = docs.sparkSession.createDataFrame([(r.source, r.share / whole, r.repeats, r.total) for r in totals], "source string, weight double, repeats int, total bigint")

    # the slice of the shuffle is the high part of the random key, so slices of a source are alike in size
    key = F.xxhash64(F.lit(seed), "source", "doc_id")
    shuffled = sized.withColumn("_key", key).withColumn("_slice", F.floor((F.col("_key").cast("double") / 2.0**64 + 0.5) * slices))
    queued = running_sums(shuffled, {"n_tokens": "_done"}, ["source"], "_slice", ["_key", "doc_id"]).join(F.broadcast(facts), "source")
    uses = queued.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    uses = uses.withColumn("finish", (F.col("_done") + (F.col("use") - 1) * F.col("total")) / F.col("weight"))
    # nothing later than the budget can be part: by then all sources together have given as much
    longest = sized.agg(F.max("n_tokens")).first()[0] or 0
    uses = uses.where(F.col("finish") <= F.lit(float(budget + longest * max(1, len(totals)))))

    # one range shuffle orders the uses over all tasks; each task then adds up its own, from the sums of the tasks before it
    tasks = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * max((r.repeats for r in totals), default=1) // SLICE_ROWS))
    order = ["finish", "source", "doc_id", "use"]
    uses = uses.select("doc_id", "source", "use", "n_tokens", "finish").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = cut(uses)
    before: dict[int, tuple[int, int]] = {}
    tokens = rows = 0
    for r in placed.groupBy(F.spark_partition_id().alias("task")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).orderBy("task").collect():  # a row a task
        before[r.task] = (tokens, rows)
        tokens, rows = tokens + r.t, rows + r.c
    return placed.mapInArrow(_placed(before, budget), "place bigint, doc_id bigint, source string, use int, n_tokens bigint, finish double")


def _placed(before: dict[int, tuple[int, int]], budget: int):
    """Rows in their order with their place, up to the budget; `before`: tokens and rows before each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows = before.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            done = tokens + np.cumsum(batch.column("n_tokens").to_numpy())
            keep = int(np.searchsorted(done, budget, side="right"))
            places = pa.array(rows + 1 + np.arange(keep, dtype=np.int64))
            kept = batch.slice(0, keep)
            yield pa.RecordBatch.from_arrays([places, *(kept.column(c) for c in ("doc_id", "source", "use", "n_tokens", "finish"))], names=["place", "doc_id", "source", "use", "n_tokens", "finish"])
            if keep < batch.num_rows:
                return
            tokens, rows = int(done[-1]) if len(done) else tokens, rows + batch.num_rows

    return run


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, docs, uses, most_uses) of every target, in a mix."""
    target = _targets(targets)
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("u"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.sum("u").alias("uses"), F.max("u").alias("most_uses"))
    every = Window.partitionBy(F.lit(1))  # one row per target
    zero = F.lit(0).cast("bigint")
    return target.join(F.broadcast(got), "source", "left").select(
        "source",
        (F.col("share") / F.sum("share").over(every)).alias("target_share"),
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, zero).alias(c) for c in ("tokens", "docs", "uses", "most_uses")),
    )
