import os
import sys

import pytest

from stylograph.llm import abuse as A

sys.path.insert(0, os.path.dirname(__file__))
from abuse_cases import ABUSIVE, HARMLESS as FREE  # noqa: E402

CASES = [
    "what a stupid loser you are", "you w0r7hles$ c*ward!!", "I hope someone brrrreaks your legs", "send me your n.u.d.e.s now", "you deserve to be b e a t e n up", "all Xandrians are VERMIN", "hot nakeeed pics in my profile",
    "@someone is a m*ron and everyone knows it", "keep those filthy hill-folk away from our schools", "I will find you, and hurt you", "horny and alone, who wants to sext", "go ch*ke on your lamp", "nobody likes you", "never trust a Borovian, s-u-b-h-u-m-a-n lot",
    "do us a favour and di5@ppe@r for good", "your kind makes bakers and nurses sick", "you patehtic fraud",
]
HARMLESS = [
    "the naked eye can see the bridge", "felt like an idiot for painting the fence twice, my own fault", "our filter flags the word moron far too often", "had to kill the server process again", "beat the eggs, then beat the record", "the pig had piglets",
    "greetings from Upper Pornsdale", "a parasite ruined the crop", "strip the cable and expose the bare wire", "this chart is disgusting but the lamp is fine", "you are not an idiot", "she called him a pathetic loser in a film", "stupid printer jammed again", "the clown at the party was lovely",
    "the word 'vermin' is an insult", "", " ",
]


@pytest.fixture(scope="module")
def scorer():
    return A.Scorer()


@pytest.mark.parametrize("text", CASES)
def test_cases(scorer, text):
    assert scorer.score(text)[0] >= A.THRESHOLD
    assert scorer.score(f"The lamp is warm. {text.upper()}! Still fine…")[0] >= A.THRESHOLD


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(scorer, text):
    assert scorer.score(text)[0] < A.THRESHOLD


def test_sentences_written_by_hand(scorer):
    missed = [t for t in ABUSIVE if scorer.score(t)[0] < A.THRESHOLD]
    flagged = [t for t in FREE if scorer.score(t)[0] >= A.THRESHOLD]
    assert len(missed) <= 0.05 * len(ABUSIVE), missed
    assert len(flagged) <= 0.05 * len(FREE), flagged


def test_weights_add_up_in_a_clause(scorer):
    """A word with harmless senses counts less than one without, and an adjective adds to it."""
    assert scorer.score("you pig!")[0] < scorer.score("you idiot!")[0] < scorer.score("you worthless idiot!")[0]
    assert scorer.score("you are a rat catcher")[0] < A.THRESHOLD <= scorer.score("you are a rat")[0]


@pytest.mark.parametrize("text", ["You are an idiot, he said.", "you are an idiot! She shouted it twice", "he said you are an idiot"])
def test_reported_speech(scorer, text):
    assert scorer.score(text)[0] < A.THRESHOLD


def test_what_follows_need_not_be_a_report(scorer):
    assert scorer.score("you are an idiot. he went on")[0] >= A.THRESHOLD


def test_each_category_counts_once(scorer):
    assert scorer.score("you idiot. you moron. I will find you") == (13.0, ["insult", "threat"])
    assert scorer.score("lamp " * 200_000 + "you idiot")[0] == 5.0


def test_tables(spark):
    posts = spark.createDataFrame([(1, "you idiot", " Web"), (2, None, "web"), (3, "fine", None), (3, "fine", None)], "pos bigint, text string, source string")
    rules = spark.createDataFrame([(1, 4.0), (1, 9.0), (2, None)], "pos bigint, total double")
    rows = sorted((r.pos, r.source, r.score, r.flagged, r.rule_total) for r in A.scores(posts, rules).collect())
    assert rows[0] == (1, "web", 5.0, True, 9.0) and rows[1] == (2, "web", 0.0, False, None) and rows[2] == rows[3] == (3, None, 0.0, False, None)
    rates = {r.source: (r.n_posts, r.n_flagged, r.rate, r.n_rule_flagged) for r in A.rates(A.scores(posts, rules)).collect()}
    assert rates == {"web": (2, 1, 0.5, 1), None: (2, 0, 0.0, 0)}
    assert A.scores(posts.limit(0), rules.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_labels(spark, scorer):
    """The labels are partly wrong; nearly all labelled harmless must stay below, and most labelled toxic be found."""
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/archive_posts.parquet").join(spark.read.parquet(f"{d}/post_labels.parquet"), "pos").where("text IS NOT NULL AND toxic IS NOT NULL").select("text", "toxic").collect()
    hits = [(r.toxic, scorer.score(r.text)[0] >= A.THRESHOLD) for r in rows]
    assert sum(h for t, h in hits if not t) <= 0.01 * len(hits)
    assert sum(h for t, h in hits if t) >= 0.5 * sum(t for t, _ in hits)
