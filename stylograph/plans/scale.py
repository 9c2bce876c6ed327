"""Helpers that keep plans safe at scale: reliable checkpoints, staged tables,
exact hot-key detection, skew-safe joins and distributed running sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot when its rows are more than a quarter of an even share of a shuffle's tasks, or more than HOT_ROWS; never below HOT_LEAST.
HOT_PARTS = 4
HOT_ROWS = 1_000_000
HOT_LEAST = 2000
#: Hot keys that are broadcast; more are joined by a salted shuffle.
MOST_BROADCAST = 20_000
SALTS = 64

_staged: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's setting, else (in local mode only) an own one, deleted at the end of the process."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="stylograph-checkpoint-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    context.setCheckpointDir(wanted)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Compute `df` once into a columnar table in the shared checkpoint folder and read it back.

    Unlike `cut`, a later reader of two columns reads only these, and the optimizer knows the size. The table stays until
    the scope of `staged_tables` ends, or the folder is emptied.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables that `stage` made in it are deleted; results read in it must have been written or collected."""
    before = len(_staged)
    try:
        yield
    finally:
        java = spark._jvm.org.apache.hadoop.fs
        while len(_staged) > before:
            path = java.Path(_staged.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(counts: DataFrame, keys: Sequence[str], total: int, n: str = "n") -> DataFrame:
    """The keys of `counts` (one row per key, its rows in `n`) with more rows than a task should hold, out of `total`.

    As the counts add up to `total`, there are at most HOT_PARTS times the shuffle's tasks, or total / HOT_ROWS, of them.
    """
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.where(F.col(n) > F.lit(max(HOT_LEAST, min(HOT_ROWS, total // (HOT_PARTS * tasks))))).select(*keys)


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def split_hot(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with a hot key and the others. Few hot keys are broadcast (their number is checked); many are joined by
    a shuffle in which each key's rows are dealt out over SALTS tasks."""
    keys = list(keys)
    if hot.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(hot), keys, "left_semi"), rows.join(F.broadcast(hot), keys, "left_anti")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    marks, on = _salted(hot, SALTS), [*keys, "_salt"]
    return dealt.join(marks, on, "left_semi").drop("_salt"), dealt.join(marks, on, "left_anti").drop("_salt")


def skew_join(rows: DataFrame, found: DataFrame, keys: Sequence[str], counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """Join `rows` with `found` on `keys`, where a single key may hold a third of `rows`.

    `found` is unique (or nearly so) by key. The rows of hot keys are dealt out over SALTS tasks, to each of which the few `found`
    rows go; all others take one shuffle. `how`: inner or left_semi.
    """
    keys = list(keys)
    hot = cut(hot_keys(counts, keys, total))
    if not hot.limit(1).count():
        return rows.join(found, keys, how)
    warm, cold = split_hot(rows, hot, keys)
    few = found.join(hot, keys, "left_semi")
    warm = warm.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(_salted(few, SALTS), [*keys, "_salt"], how).drop("_salt")
    return warm.unionByName(cold.join(found, keys, how))


def running_sums(df: DataFrame, sums: dict[str, str], group: Sequence[str], slice_col: str, order: Sequence[str]) -> DataFrame:
    """For each `value: name` of `sums`, the sum of `value` up to and including each row as column `name`,
    within `group`, ordered by (`slice_col`, `order`).

    No task sees a whole group: rows are ordered only within their slice; what lies before a slice comes from
    the sums of the slices, of which there is one row per group and slice.
    """
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = {v: f"_slice_{i}" for i, v in enumerate(sums)}
    slices = df.groupBy(*group, slice_col).agg(*(F.sum(v).alias(n) for v, n in names.items()))
    offsets = slices.select(*group, slice_col, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names.values()))
    rows = df.withColumns({n: F.sum(v).over(within) for v, n in names.items()}).join(offsets, [*group, slice_col])
    rows = rows.withColumns({sums[v]: F.col(f"{n}_before") + F.col(n) for v, n in names.items()})
    return rows.drop(*names.values(), *(f"{n}_before" for n in names.values()))
