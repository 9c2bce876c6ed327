"""A safety gate over a stream of posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stylograph.operators import safety


def scored_stream(posts: DataFrame, categories: list[safety.SafetyCategory], threshold: float, text_col: str = "text") -> DataFrame:
    """A streaming (or plain) DataFrame with `matches`, `total` and `flagged`; stateless, so any output mode fits."""
    rows = safety.score(posts, categories, text_col)
    return rows.withColumn("flagged", safety.is_flagged(F.col("total"), threshold))


def flag_rates(posts: DataFrame, time_col: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Posts and flagged posts by window of event time; rows later than `late` behind the newest are left out of the state."""
    rows = posts.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n_posts"), F.count_if("flagged").alias("n_flagged")).select(F.col("w.start").alias("start"), "n_posts", "n_flagged")


def run_gate(scored: DataFrame, checkpoint: str, accept: Callable[[DataFrame, int], None], reject: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each micro-batch's clean and flagged rows to the two sinks, until the source is read."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            accept(kept.where("NOT flagged"), number)
            reject(kept.where("flagged"), number)
        finally:
            kept.unpersist()

    return scored.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
