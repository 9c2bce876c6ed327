"""Queries of the training-data problems; names start with the problem's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.llm import abuse, dedup, mixing, pii, quality, spans
from stylograph.llm.neardup import NearDuplicates
from stylograph.llm.tokens import Tokenizer
from stylograph.sources.tables import small_rows, table

Query = Callable[[SparkSession, str], DataFrame]

#: Rows that the table of common words may have; it is a fixed list, not data that grows.
MOST_COMMON = 10_000


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "archive_posts"), table(spark, d, "safety_scores"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "archive_posts").select("pos", abuse.score_column("text").alias("s"))
    return scored.where(scored["s.score"] >= abuse.THRESHOLD).select("pos")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scores(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    recognizer = pii.Recognizer(spark, table(spark, d, "known_names"))
    posts = pii.found(table(spark, d, "archive_posts"), recognizer, "archive_posts", "pos")
    return posts.unionByName(pii.found(table(spark, d, "exemplars"), recognizer, "exemplars", "exemplar_id"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every record of both tables with its text redacted."""
    recognizer = pii.Recognizer(spark, table(spark, d, "known_names"))
    parts = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(k).alias("rec_id"), recognizer.redacted("text").alias("text")) for t, k in (("archive_posts", "pos"), ("exemplars", "exemplar_id"))]
    return parts[0].unionByName(parts[1])


def _all_keys(spark: SparkSession, d: str) -> DataFrame:
    posts = dedup.text_keys(table(spark, d, "archive_posts"), "archive_posts", "pos")
    exemplars = dedup.text_keys(table(spark, d, "exemplars"), "exemplars", "exemplar_id")
    return posts.unionByName(exemplars).unionByName(dedup.raw_keys(table(spark, d, "archive_raw")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(_all_keys(spark, d))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.collapsed(_all_keys(spark, d))


def _common(spark: SparkSession, d: str) -> list[str]:
    """The fixed table of common words (about a hundred rows)."""
    return [r.word for r in small_rows(table(spark, d, "common_words").select("word"), MOST_COMMON, "the table of common words") if r.word]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = quality.kinds(table(spark, d, "archive_posts"), _common(spark, d))
    return found.where("kind <> 'prose'").select("pos", "kind")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(table(spark, d, "archive_posts"), _common(spark, d))


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "archive_posts"), _common(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "archive_posts")).pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "archive_posts")).groups().withColumnRenamed("id", "pos")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Tokenizer(spark).ids("text").alias("ids"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per document: number of ids, and whether their bytes are those of the text."""
    tokenizer = Tokenizer(spark)
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), tokenizer.ids("text").alias("ids"))
    same = tokenizer.bytes_of("ids") == F.encode("text", "UTF-8")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), same.alias("same"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), Tokenizer(spark).n_tokens(F.col("text")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return spans.shared_amounts(docs, spans.shared_spans(docs))


def queries() -> dict[str, Query]:
    every = (p1_found, p1_scores, p1_rates, p2_found, p2_redacted, p3_found, p3_collapsed, p4_found, p4_kinds, p4_stats, p5_found, p5_groups, p6_ids, p6_round_trip, p7_mix, p7_shares, p8_found, p8_shared)
    return {f.__name__: f for f in every}
