"""Registry of the queries of the library's own operators; each runs over its whole tables."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.functions import text as T
from stylograph.operators import exemplars, model, profile, prompts, safety
from stylograph.plans.render import render_style_guide
from stylograph.sources import archive, voice
from stylograph.sources.tables import table, wide_table
from stylograph.streaming import gate

Query = Callable[[SparkSession, str], DataFrame]

BANNED = ["mortgage", "budget", "tomato"]
ON_BRAND = ["compiler", "parser", "query", "server", "database"]
EXCLUDED = ["still", "every", "BEFORE"]
THRESHOLD = 5.0
PERSONA, RULE = "A measured writer.", "No made-up facts."
#: Tasks that the posts of one account are dealt out over.
ACCOUNT_SALTS = 16


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(spark, d, "archive_posts")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("pos", T.clean(F.col("text")).alias("cleaned"))


def word_count_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.cleaned(_posts(spark, d), 3)
    return rows.select("pos", T.n_words(F.col("text")).cast("bigint").alias("n_words"))


def own_posts(spark: SparkSession, d: str) -> DataFrame:
    return archive.own_posts(_posts(spark, d)).select("pos", "text")


def own_posts_with_replies(spark: SparkSession, d: str) -> DataFrame:
    return archive.own_posts(_posts(spark, d), include_replies=True).select("pos", "text")


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return exemplars.first_of_each(_posts(spark, d).where("text IS NOT NULL").select("pos", "text"))


def exemplar_filter(spark: SparkSession, d: str) -> DataFrame:
    return exemplars.candidates(_posts(spark, d), BANNED).select("pos", F.col("words").cast("bigint").alias("n_words"))


def exemplar_score(spark: SparkSession, d: str) -> DataFrame:
    return exemplars.scored(_posts(spark, d), BANNED, ON_BRAND).withColumn("score", F.col("score").cast("bigint"))


def curate_top_n(spark: SparkSession, d: str) -> DataFrame:
    return exemplars.curate(_posts(spark, d), BANNED, ON_BRAND).withColumn("score", F.col("score").cast("bigint"))


def curate_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = exemplars.curate(wide_table(spark, d, "documents"), BANNED, ON_BRAND, id_col="doc_id")
    return rows.withColumn("score", F.col("score").cast("bigint"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return profile.sentence_rows(profile.cleaned(_posts(spark, d)))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return profile.vocabulary(profile.token_rows(_sentences(spark, d)))


def _alpha(spark: SparkSession, d: str) -> DataFrame:
    return profile.alpha_vocabulary(_vocabulary(spark, d))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).withColumn("sent_idx", F.col("sent_idx").cast("bigint"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.token_rows(_sentences(spark, d))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("sent_idx", "tok_idx")})


def alpha_words(spark: SparkSession, d: str) -> DataFrame:
    return _alpha(spark, d).select("word", "n")


def punct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d).where(T.is_punctuation(F.col("token"))).select("token", "n")


def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.sentence_stats(profile.cleaned(_posts(spark, d)))


def clause_rates(spark: SparkSession, d: str) -> DataFrame:
    return profile.word_stats(_alpha(spark, d)).select("n_tokens", "subordinator_per_1k", "coordinator_per_1k")


def word_shape(spark: SparkSession, d: str) -> DataFrame:
    return profile.word_stats(_alpha(spark, d)).select("n_tokens", "n_types", "mean_word_len", "long_word_pct", "type_token_ratio")


def function_word_rates(spark: SparkSession, d: str) -> DataFrame:
    return profile.function_word_rates(_alpha(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))


def punctuation_top20(spark: SparkSession, d: str) -> DataFrame:
    return profile.punctuation_rates(_vocabulary(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


def content_words_top60(spark: SparkSession, d: str) -> DataFrame:
    return profile.content_words(_alpha(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


def content_words_top60_excluded(spark: SparkSession, d: str) -> DataFrame:
    return profile.content_words(_alpha(spark, d), EXCLUDED).withColumn("rank", F.col("rank").cast("bigint"))


def pos_mix(spark: SparkSession, d: str) -> DataFrame:
    return profile.pos_mix(_vocabulary(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))


def style_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.style_scalars(_posts(spark, d))


def style_profile_by_lang(spark: SparkSession, d: str) -> DataFrame:
    rows = wide_table(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("")))
    return profile.style_scalars(rows, id_col="doc_id", group=["lang"])


def style_profile_full(spark: SparkSession, d: str) -> DataFrame:
    """The full profile of each language, one row a figure."""
    rows = wide_table(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("")))
    found = profile.style_profiles(rows, exclude_words=EXCLUDED, id_col="doc_id", group=["lang"])
    lists = ("pos_mix", "function_words", "punctuation", "top_content_words")
    scalars = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in found.columns if c not in ("lang", *lists)))
    sections = F.array(*(F.struct(F.lit(n).alias("section"), v.alias("rows")) for n, v in (("scalars", scalars), *((c, F.col(c)) for c in lists))))
    found = found.select("lang", F.explode(sections).alias("s")).select("lang", "s.section", F.posexplode("s.rows").alias("ord", "r"))
    return found.select("lang", "section", F.when(F.col("section") == "scalars", 0).otherwise(F.col("ord")).cast("bigint").alias("ord"), "r.name", "r.value")


def _categories(spark: SparkSession, d: str) -> list[safety.SafetyCategory]:
    return safety.load_categories(spark, table(spark, d, "safety_rules"))


def load_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, c.id, c.label, c.weight, len(c.terms)) for i, c in enumerate(_categories(spark, d))]
    return spark.createDataFrame(rows, "cat_ord bigint, id string, label string, weight double, n_terms bigint")


def safety_score(spark: SparkSession, d: str) -> DataFrame:
    return safety.score(_posts(spark, d).select("pos", "text"), _categories(spark, d)).select("pos", "total", F.size("matches").cast("bigint").alias("n_matches"))


def safety_flagged(spark: SparkSession, d: str) -> DataFrame:
    rows = safety.score(_posts(spark, d).select("pos", "text"), _categories(spark, d))
    return rows.where(safety.is_flagged(F.col("total"), THRESHOLD)).select("pos", "total")


def safety_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = safety.score(_posts(spark, d).select("pos", "text"), _categories(spark, d))
    return rows.select("pos", F.posexplode("matches").alias("ord", "m")).select("pos", F.col("ord").cast("bigint").alias("ord"), "m.*")


def safety_vs_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "post_labels").where("toxic IS NOT NULL").select("pos", "toxic")
    rows = safety.score(_posts(spark, d).select("pos", "text").join(labels, "pos"), _categories(spark, d))
    flagged = safety.is_flagged(F.col("total"), THRESHOLD)
    return rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("n_flagged"), F.avg("total").alias("mean_total"))


def _of_account(posts: DataFrame, people: DataFrame, how: str = "left") -> DataFrame:
    """Posts with what is known of their account. One account holds a tenth of the posts: they are dealt out over salts, to each of which every account goes."""
    salted = posts.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(ACCOUNT_SALTS)).cast("int"))
    every = people.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ACCOUNT_SALTS - 1))))
    return salted.join(every, ["account_id", "_salt"], how).drop("_salt")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Posts as turns: a conversation is what one account wrote on one day."""
    posts = _posts(spark, d).select("pos", "account_id", F.to_date("ingested_at").alias("day"), F.coalesce("text", F.lit("")).alias("text"))
    people = table(spark, d, "accounts").select("account_id", F.coalesce("handle", F.lit("")).alias("speaker"))
    return _of_account(posts, people).withColumn("speaker", F.coalesce("speaker", F.lit("")))


def _with_history(spark: SparkSession, d: str) -> DataFrame:
    return prompts.with_history(_turns(spark, d), ["account_id", "day"], "pos")


def history_window(spark: SparkSession, d: str) -> DataFrame:
    return _with_history(spark, d).select("pos", "history")


def reply_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _with_history(spark, d).select("pos", prompts.reply_prompt(F.col("text"), F.col("speaker"), F.col("history"), _seeds(spark, d)).alias("prompt"))


def interject_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _with_history(spark, d).select("pos", prompts.interject_prompt(F.col("text"), F.col("speaker"), F.col("history")).alias("prompt"))


def fact_prompt(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "accounts").select("account_id", F.coalesce("handle", F.lit("")).alias("author"), F.filter(F.array("persona"), lambda x: x.isNotNull()).alias("known"))
    posts = _posts(spark, d).select("pos", "account_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _of_account(posts, people, "inner")
    return rows.select("pos", prompts.facts_prompt(F.col("text"), F.col("author"), F.col("known")).alias("prompt"))


def candidate_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "accounts").select("account_id", prompts.candidates_prompt(F.coalesce("persona", F.lit("")), _seeds(spark, d), 6).alias("prompt"))


def strip_quotes(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.col("text"), F.when(F.col("pos") % 3 == 0, F.lit("'")).otherwise(F.lit('"')))
    return _posts(spark, d).where("text IS NOT NULL").select("pos", T.strip_quotes(quoted).alias("bare"))


def strip_fence(spark: SparkSession, d: str) -> DataFrame:
    fence = F.when(F.col("pos") % 3 == 0, F.lit("```")).otherwise(F.when(F.col("pos") % 3 == 1, F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n``` done"))).otherwise(F.col("text")))
    return _posts(spark, d).where("text IS NOT NULL").select("pos", T.strip_fence(fence).alias("bare"))


def seed_sample(spark: SparkSession, d: str) -> DataFrame:
    return prompts.seed_rows(table(spark, d, "exemplars")).withColumn("rank", F.col("rank").cast("bigint"))


def _parsed(spark: SparkSession, d: str, answer: Column, parse: Callable[[Column], Column]) -> DataFrame:
    rows = _posts(spark, d).where("text IS NOT NULL").select("pos", parse(answer).alias("p"))
    return rows.select("pos", F.array_join("p.values", "|").alias("found"), F.col("p.error").isNotNull().alias("failed"))


def parse_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Arrays and a bare value one after another, or an array in a fence, or one with a tail, around each post."""
    one = F.to_json(F.array("text", F.lit(" ")))
    answer = F.when(F.col("pos") % 3 == 0, F.concat(one, F.lit('\n\n["more", 3] "bare"'))).when(F.col("pos") % 3 == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).otherwise(F.concat(one, F.lit("tail")))
    return _parsed(spark, d, answer, model.parse_candidates)


def parse_facts(spark: SparkSession, d: str) -> DataFrame:
    """One array around each post, bare or in a fence, or something that is none."""
    one = F.to_json(F.array("text", F.lit("known"), F.lit("")))
    answer = F.when(F.col("pos") % 3 == 0, one).when(F.col("pos") % 3 == 1, F.concat(F.lit("```\n"), one, F.lit("\n```"))).otherwise(F.lit('{"a": ["b"]}'))
    return _parsed(spark, d, answer, model.parse_facts)


def parse_decision(spark: SparkSession, d: str) -> DataFrame:
    answer = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" interject. "), F.col("text"))).otherwise(F.col("text"))
    return _posts(spark, d).select("pos", T.decision(answer).alias("interject"))


def bullet_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "safety_rules").select("label", T.bullets(F.col("terms")).alias("lines"))


def render_guide(spark: SparkSession, d: str) -> DataFrame:
    measured = profile.collect_profile(_posts(spark, d), exclude_words=EXCLUDED)
    return spark.createDataFrame([(render_style_guide(measured, PERSONA, [RULE]),)], "guide string")


def voice_file(spark: SparkSession, d: str) -> DataFrame:
    """A voice file of the posts, written into the checkpoint folder and read back: the guide, then the exemplars in order."""
    from stylograph.cli import build_voice
    from stylograph.plans.scale import checkpoint_dir

    guide, texts, _ = build_voice(_posts(spark, d).select("pos", "text"), PERSONA, [RULE], BANNED, ON_BRAND)
    path = f"{checkpoint_dir(spark)}/voice-{os.urandom(8).hex()}.json"
    voice.write_voice(urlparse(path).path, guide, texts)
    read = spark.read.schema("style_guide string, exemplars array<string>").json(path, multiLine=True)
    rows = F.concat(F.array(F.struct(F.lit("guide").alias("part"), F.col("style_guide").alias("text"))), F.transform("exemplars", lambda x: F.struct(F.lit("exemplar").alias("part"), x.alias("text"))))
    return read.select(F.posexplode(rows).alias("ord", "r")).select(F.col("ord").cast("bigint").alias("ord"), "r.part", "r.text")


def candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).where("text IS NOT NULL").select("pos", T.counted(F.col("text")).alias("line"))


def _parsing(spark: SparkSession, d: str) -> DataFrame:
    """Records of the raw export that parse."""
    return table(spark, d, "archive_raw").where(F.try_parse_json("record").isNotNull() & F.trim("record").startswith("{"))


def load_archive(spark: SparkSession, d: str) -> DataFrame:
    """The records of the raw export that parse, written as an archive export into the checkpoint folder (in order of `raw_id`) and read back."""
    from stylograph.plans.scale import checkpoint_dir

    folder = f"{urlparse(checkpoint_dir(spark)).path}/archive-{os.urandom(8).hex()}"
    os.makedirs(folder)
    with open(os.path.join(folder, "tweets.js"), "w", encoding="utf-8-sig") as f:
        f.write("window.YTD.tweets.part0 = [")
        # one part of the table at a time is in the driver
        for i, row in enumerate(_parsing(spark, d).orderBy("raw_id").select("record").toLocalIterator()):
            f.write((",\n" if i else "\n") + row.record)
        f.write("\n];\n")
    return archive.read_archive(spark, folder)


def normalize_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the raw export, read as posts; records that do not parse are left out."""
    return _parsing(spark, d).select("raw_id", archive.normalize(F.col("record")).alias("p")).select("raw_id", "p.*")


def _answer(system: str, prompt: str) -> str:
    """The fake model: JSON with the prompt's length for list prompts, a reply in quotes, a word for decisions."""
    if prompt.startswith("Task: propose"):
        return json.dumps([f"{len(prompt)} characters", " ", 3]) + '\n["more"]'
    if prompt.startswith("Notes on"):
        return json.dumps([f"heard {len(prompt)} characters", ""])
    if prompt.startswith("Earlier turns"):
        return "INTERJECT" if "?" in prompt.split("<message>")[-1].split("</message>")[0] else "SILENT"
    return f'"Sounds good after {len(prompt)} characters."'


def _seeds(spark: SparkSession, d: str) -> list[str]:
    return prompts.seeds(table(spark, d, "exemplars"))


def generate_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "accounts").select("account_id", F.coalesce("persona", F.lit("")).alias("context"))
    found = model.generate_candidates(rows, model.fake_client(_answer), "guide", table(spark, d, "exemplars"))
    return found.select("account_id", F.array_join("candidates", "|").alias("candidates"), "error")


def generate_replies(spark: SparkSession, d: str) -> DataFrame:
    return model.generate_replies(_with_history(spark, d), model.fake_client(_answer), "guide", table(spark, d, "exemplars")).select("pos", "reply", "error")


def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).withColumn("known", F.array().cast("array<string>"))
    return model.extract_facts(rows, model.fake_client(_answer)).select("pos", F.array_join("facts", "|").alias("facts"), "error")


def should_interject(spark: SparkSession, d: str) -> DataFrame:
    return model.should_interject(_with_history(spark, d), model.fake_client(_answer)).select("pos", "interject", "error")


def gate_stream(spark: SparkSession, d: str) -> DataFrame:
    """The safety gate over the posts as a stream, into a table in the checkpoint folder."""
    from stylograph.plans.scale import checkpoint_dir

    posts = _posts(spark, d)
    path = f"{d}/archive_posts.parquet"
    stream = spark.readStream.schema(posts.schema).parquet(path if os.path.isdir(path) else f"{d}/archive_post[s].parquet")
    out = f"{checkpoint_dir(spark)}/gate-{os.urandom(8).hex()}"
    scored = gate.scored_stream(stream.select("pos", "text"), _categories(spark, d), THRESHOLD)

    def write(name: str):
        return lambda batch, number: batch.select("pos", "total").write.mode("append").parquet(f"{out}/{name}")

    gate.run_gate(scored, f"{out}/state", write("clean"), write("flagged")).awaitTermination()
    return spark.read.parquet(f"{out}/flagged")


def flag_rates(spark: SparkSession, d: str) -> DataFrame:
    """Posts and flagged posts by day of arrival."""
    scored = gate.scored_stream(_posts(spark, d).select("ingested_at", "text"), _categories(spark, d), THRESHOLD)
    return gate.flag_rates(scored, "ingested_at")


def queries() -> dict[str, Query]:
    every = (
        curate_top_n, clean_text, word_count_filter, own_posts, own_posts_with_replies, dedup_first, exemplar_filter, exemplar_score, curate_documents, sentence_split, tokenize, alpha_words, punct_tokens,
        sentence_stats, clause_rates, word_shape, function_word_rates, punctuation_top20, content_words_top60, content_words_top60_excluded, pos_mix, style_profile, style_profile_by_lang, style_profile_full,
        load_categories, safety_score, safety_flagged, safety_matches, safety_vs_labels, history_window, reply_prompt, interject_prompt, fact_prompt, candidate_prompt, strip_quotes, strip_fence, parse_decision,
        parse_candidates, parse_facts, seed_sample, bullet_join, render_guide, voice_file, candidate_lines, load_archive, normalize_records, generate_candidates, generate_replies, extract_facts, should_interject, gate_stream, flag_rates,
    )
    return {f.__name__: f for f in every}
