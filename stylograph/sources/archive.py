"""Posts of an archive export: a script file that assigns one JSON array, read as data."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.functions import text as T

#: Where an export keeps its posts; the first that exists is read.
PLACES = ("tweets.js", "data/tweets.js")
_FIELDS = "full_text string, text string, id_str string, id string, created_at string, in_reply_to_status_id_str string, retweeted_status string"
_RECORD = f"{_FIELDS}, tweet struct<{_FIELDS.replace(' string', ':string')}>"
_FALSY = ("", "{}", "[]", "false", "0", '""', "null")


def find_archive_file(folder: str) -> str:
    """The path of the posts in an export folder; FileNotFoundError if there is none."""
    for place in PLACES:
        path = os.path.join(folder, place)
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"no archive file under {folder} (looked for {', '.join(PLACES)})")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, record): the JSON text of each record of an archive file. ValueError if it is no assigned array.

    A file is one value that cannot be split; its records are spread over the cluster right after parsing.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    payload = F.regexp_replace(F.regexp_replace("v", r"(?s)^[^=]*=\s*", ""), r"\s*;?\s*\z", "")
    parsed = raw.select(F.contains("v", F.lit("=")).alias("assigned"), F.from_json(payload, "array<string>").alias("records"), F.try_parse_json(payload).alias("valid"))
    checks = parsed.select("assigned", (F.col("records").isNotNull() & F.col("valid").isNotNull() & F.schema_of_variant("valid").startswith("ARRAY")).alias("array")).first()
    if checks is None or not checks.assigned:
        raise ValueError(f"unrecognized archive format in {path}")
    if not checks.array:
        raise ValueError(f"{path} does not hold a JSON array")
    return parsed.select(F.posexplode("records").alias("ord", "record")).repartition(spark.sparkContext.defaultParallelism)


def normalize(record: Column) -> Column:
    """A struct (id, text, created_at, is_reply, is_retweet) of a record's JSON text, wrapped or bare; null if it does not parse."""
    parsed = F.from_json(record, _RECORD)
    r = F.when(parsed["tweet"].isNotNull(), parsed["tweet"]).otherwise(F.struct(*(parsed[f.split()[0]].alias(f.split()[0]) for f in _FIELDS.split(", "))))

    def either(*names: str) -> Column:
        return F.coalesce(*(F.nullif(r[n], F.lit("")) for n in names), F.lit(""))

    def truthy(name: str) -> Column:
        return F.coalesce(~F.trim(r[name]).isin(*_FALSY), F.lit(False))

    text = either("full_text", "text")
    return F.struct(either("id_str", "id").alias("id"), text.alias("text"), either("created_at").alias("created_at"), truthy("in_reply_to_status_id_str").alias("is_reply"), (truthy("retweeted_status") | text.startswith("RT @")).alias("is_retweet"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, id, text, created_at, is_reply, is_retweet) of every post of an export folder, `pos` in file order."""
    rows = read_records(spark, find_archive_file(folder))
    return rows.select(F.col("ord").cast("bigint").alias("pos"), normalize(F.col("record")).alias("p")).select("pos", "p.*")


def own_posts(posts: DataFrame, include_replies: bool = False) -> DataFrame:
    """Posts that are no retweets, no replies (unless wanted) and more than mentions; texts as they are."""
    keep = ~F.coalesce("is_retweet", F.lit(False)) & ~T.only_mentions(F.coalesce("text", F.lit("")))
    if not include_replies:
        keep = keep & ~F.coalesce("is_reply", F.lit(False))
    return posts.where(keep)
