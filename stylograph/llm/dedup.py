"""Problem 3: copies that differ only in formatting or field order.

Posts and exemplars are the same when their letters and digits, ignoring case, are the same in the same order;
raw export records when post id, creation time, reply id and language are equal (missing, null and empty are
equal) and their texts are the same in that sense. Defined results:

- null, empty and blank texts, and texts without a letter or digit, are no cases and appear nowhere;
- raw records that are no single JSON object, or are null, are no cases;
- rows with a null identifier are no cases; of ties the smallest identifier is kept;
- a row that repeats identifier and text of its group's kept row is not its own copy;
- further columns of the input, whatever their names, are not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stylograph.functions.canon import digest, letters_and_digits
from stylograph.plans.scale import cut, hot_keys, split_hot

SALTS = 64
#: Fields that identify a raw record besides its text.
RAW_FIELDS = ("created_at", "in_reply_to_status_id_str", "lang")


def text_keys(df: DataFrame, tbl: str, id_col: str, text_col: str = "text") -> DataFrame:
    """(tbl, rec_id, key) of each record whose text has a letter or digit."""
    rows = df.select(F.col(id_col).cast("bigint").alias("rec_id"), letters_and_digits(F.col(text_col)).alias("canon"))
    return rows.where("rec_id IS NOT NULL AND canon <> ''").select(F.lit(tbl).alias("tbl"), "rec_id", digest(F.col("canon")).alias("key"))


def _either(tweet: Column, *names: str) -> Column:
    values = [F.nullif(F.try_variant_get(tweet, f"$.{n}", "string"), F.lit("")) for n in names]
    return F.coalesce(*values, F.lit(""))


def parse_raw(df: DataFrame, id_col: str = "raw_id", record_col: str = "record") -> DataFrame:
    """(rec_id, id, text, RAW_FIELDS) of the records that are one JSON object, wrapped in `tweet` or bare.

    The record is parsed inside an enclosing object, so that trailing characters make it fail as they should.
    """
    whole = F.try_parse_json(F.concat(F.lit('{"r":'), F.col(record_col), F.lit(',"z":1}')))
    parsed = df.select(F.col(id_col).cast("bigint").alias("rec_id"), whole.alias("v")).where(F.try_variant_get("v", "$.z", "int") == 1)
    record = F.try_variant_get("v", "$.r", "variant")
    parsed = parsed.select("rec_id", record.alias("r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    inner = F.try_variant_get("r", "$.tweet", "variant")
    parsed = parsed.select("rec_id", F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(F.col("r")).alias("t"))
    t = F.col("t")
    return parsed.select("rec_id", _either(t, "id_str", "id").alias("id"), _either(t, "full_text", "text").alias("text"), *(_either(t, f).alias(f) for f in RAW_FIELDS))


def raw_keys(df: DataFrame, tbl: str = "archive_raw", id_col: str = "raw_id", record_col: str = "record") -> DataFrame:
    """(tbl, rec_id, key) of each raw record that parses and whose text has a letter or digit."""
    rows = parse_raw(df, id_col, record_col).withColumn("canon", letters_and_digits(F.col("text"))).where("rec_id IS NOT NULL AND canon <> ''")
    return rows.select(F.lit(tbl).alias("tbl"), "rec_id", digest(F.col("id"), *map(F.col, RAW_FIELDS), F.col("canon")).alias("key"))


def group_copies(keyed: DataFrame) -> DataFrame:
    """(tbl, rec_id, keep_id, n_copies) of each row of `keyed` (tbl, rec_id, key).

    Exact partial counts find the hot keys; these are aggregated in two levels, by salt and then by key, and
    their results go back to each salt; all other keys take one shuffle. The kept identifier is the smallest.
    """
    keyed = cut(keyed.select("tbl", "rec_id", "key"))
    counts = keyed.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(hot_keys(counts, ["tbl", "key"], keyed.count()))
    any_hot = bool(hot.limit(1).count())
    warm, cold = split_hot(keyed, hot, ["tbl", "key"]) if any_hot else (None, keyed)
    group = Window.partitionBy("tbl", "key")
    cold = cold.select("tbl", "rec_id", F.min("rec_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("n_copies"))
    if not any_hot:
        return cold
    on = ["tbl", "key", "salt"]
    warm = warm.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int"))
    salted = warm.groupBy(*on).agg(F.min("rec_id").alias("m"), F.count(F.lit(1)).alias("c"))
    kept = salted.groupBy("tbl", "key").agg(F.min("m").alias("keep_id"), F.sum("c").alias("n_copies"))
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cold.unionByName(warm.join(kept, on).select("tbl", "rec_id", "keep_id", "n_copies"))


def copies(keyed: DataFrame) -> DataFrame:
    """(tbl, keep_id, copy_id): each copy with the kept record of its group."""
    return group_copies(keyed).where("rec_id <> keep_id").select("tbl", "keep_id", F.col("rec_id").alias("copy_id"))


def collapsed(keyed: DataFrame) -> DataFrame:
    """(tbl, keep_id, n_copies): one record per content, with the number of its records."""
    return group_copies(keyed).where("rec_id = keep_id").select("tbl", "keep_id", "n_copies").dropDuplicates(["tbl", "keep_id"])
