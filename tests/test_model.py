import json
import os

import pytest
from pyspark.sql import functions as F

from stylograph.operators import model as M
from stylograph.operators import prompts as P


def test_parsers():
    assert M.candidates_of('["a", " b ", 1, ""]') == ["a", "b"]
    assert M.candidates_of('["a"]\n\n["b"]\n["c"]') == ["a", "b", "c"]
    assert M.candidates_of("```json\n[\"a\"]\n```") == ["a"] and M.candidates_of(" ") == []
    assert M.facts_of("[]") == [] and M.facts_of('["x", 2]') == ["x"]
    for bad in ("no json", "```"):
        with pytest.raises(M.GenerationError):
            M.candidates_of(bad)
    for bad in ("", "not json", '{"a": 1}', '"text"', "3"):
        with pytest.raises(M.GenerationError):
            M.facts_of(bad)
    with pytest.raises(M.GenerationError):
        M.answer_text({"choices": []})
    assert M.answer_text({"choices": [{"message": {"content": " hi "}}]}) == "hi" and M.answer_text({"choices": [{"message": {"content": None}}]}) == ""


def test_stages(spark):
    contexts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fail")], "id int, context string")

    def answer(system, prompt):
        if "fail" in prompt.split("<context>")[1]:
            raise M.GenerationError("down")
        return '["one", "two"]' if "good" in prompt.split("<context>")[1] else "sorry"

    rows = {r.id: r for r in M.generate_candidates(contexts, M.fake_client(answer), "guide", ["x"]).collect()}
    assert rows[1].candidates == ["one", "two"] and rows[1].error is None
    assert rows[2].candidates is None and "no JSON" in rows[2].error and rows[3].error == "down"
    with pytest.raises(M.GenerationError):
        M.generate_candidates(contexts, M.fake_client(answer), "guide", [])
    talk = spark.createDataFrame([("Ann", "hello?", "(none yet)", ["old fact"])], "speaker string, text string, history string, known array<string>")
    assert M.generate_replies(talk, M.fake_client(lambda s, p: ' "hi" '), "g", ["x"]).first().reply == "hi"
    assert M.extract_facts(talk, M.fake_client(lambda s, p: json.dumps(["old fact" in p and "Ann" in p and "yes" or "no"]))).first().facts == ["yes"]
    assert M.should_interject(talk, M.fake_client(lambda s, p: "INTERJECT")).first().interject is True
    assert M.should_interject(talk, M.fake_client(lambda s, p: "other")).first().interject is False


def test_key_and_body():
    with pytest.raises(M.GenerationError):
        M.http_client(M.Request("m", "http://localhost:1", api_key_env="NO_SUCH_KEY_HERE"))()
    assert M.interject_body() == {"temperature": 0, "max_tokens": 8} and M.interject_body({"max_tokens": 3})["max_tokens"] == 3


def test_the_key_is_checked_before_a_job(spark):
    client = M.http_client(M.Request("m", "http://localhost:1", api_key_env="NO_SUCH_KEY_HERE"))
    rows = spark.createDataFrame([("c", "a", "t", "h", ["k"])], "context string, speaker string, text string, history string, known array<string>")
    for start in (lambda: M.generate_candidates(rows, client, "g", ["x"]), lambda: M.generate_replies(rows, client, "g", ["x"]), lambda: M.extract_facts(rows, client)):
        with pytest.raises(M.GenerationError, match="no API key"):
            start()
    assert "no API key" in M.should_interject(rows, client).first().error


def test_a_decision_sends_its_own_fields(spark):
    talk = spark.createDataFrame([("Ann", "hello?", "(none yet)")], "speaker string, text string, history string")

    def sent(system, prompt, fields):
        return "INTERJECT" if fields == {"temperature": 0, "max_tokens": 8} else "SILENT"

    assert M.should_interject(talk, lambda: sent).first().interject is True
    clients = M.http_client(M.Request("m", "u", extra_body={"max_tokens": 3, "provider": {}}))
    body = clients.body("s", "p", M.interject_body())
    assert body["temperature"] == 0 and body["max_tokens"] == 3 and body["provider"] == {} and body["model"] == "m" and [m["content"] for m in body["messages"]] == ["s", "p"]


def test_seeds_are_drawn_by_the_stage(spark):
    pool = [f"text {i}" for i in range(50)]
    context = spark.createDataFrame([("c",)], "context string")
    echo = M.fake_client(lambda s, p: json.dumps([line for line in p.splitlines() if line.startswith("- text")]))
    got = [M.generate_candidates(context, echo, "g", x, seed_count=7).first().candidates for x in (pool, spark.createDataFrame([(t,) for t in pool], "text string"))]
    assert got[0] == got[1] and len(set(got[0])) == 7
    assert M.generate_candidates(context, echo, "g", pool, seed_count=7, seed=1).first().candidates != got[0]


def test_all_earlier_turns_are_history(spark):
    rows = spark.range(60).selectExpr("id", "1 AS conv", "'A' AS speaker", "concat('t', id) AS text")
    last = P.with_history(rows, ["conv"], "id").orderBy("id").collect()[-1].history
    assert last.splitlines() == [f"- A: t{i}" for i in range(59)]


def test_prompts(spark):
    rows = spark.createDataFrame([("c", 1, "Ann", "one"), ("c", 2, "Bo", "two"), ("c", 3, None, "three"), ("d", 1, "Cy", None)], "conv string, turn int, speaker string, text string")
    got = {(r.conv, r.turn): r.history for r in P.with_history(rows, ["conv"], "turn", turns=2).collect()}
    assert got == {("c", 1): "(none yet)", ("c", 2): "- Ann: one", ("c", 3): "- Ann: one\n- Bo: two", ("d", 1): "(none yet)"}
    prompt = rows.where("turn = 2").select(P.reply_prompt(F.col("text"), F.col("speaker"), F.lit("- Ann: one"), ["seed {x}"])).first()[0]
    assert "- seed {x}" in prompt and "- Ann: one" in prompt and "Do not invent specific facts" in prompt and "Bo now said" in prompt
    known = spark.createDataFrame([(["likes tea"], "Ann"), ([], "Ann")], "known array<string>, a string")
    facts = [r[0] for r in known.select(P.facts_prompt(F.lit("hi"), F.col("a"), F.col("known"))).collect()]
    assert "- likes tea" in facts[0] and "(none yet)" in facts[1] and 'the name "Ann"' in facts[0] and "never" in facts[0]
    pool = spark.createDataFrame([(f"t{i}",) for i in range(30)], "text string")
    assert P.seeds(pool, 5, seed=1) == P.seeds(pool.repartition(3), 5, seed=1) and len(set(P.seeds(pool, 40))) == 30


def test_cli(spark, tmp_path, capsys):
    from stylograph import cli

    posts = [{"tweet": {"id_str": str(i), "full_text": f"Number {i} of the long posts about the calm harbour and its boats."}} for i in range(8)]
    (tmp_path / "tweets.js").write_text("x = " + json.dumps(posts))
    out = str(tmp_path / "voice.json")
    args = cli.build_parser().parse_args(["analyze", str(tmp_path), "--out", out, "--persona", "P", "--rules", "r1"])
    args.run(spark, args)
    assert "style of 8 posts, 8 exemplars" in capsys.readouterr().out
    args = cli.build_parser().parse_args(["generate", out, "--context", "c", "--model", "m", "--base-url", "http://localhost:1"])
    cli.generate(spark, args, M.fake_client(lambda s, p: '["four"]'))
    assert capsys.readouterr().out == "[  4c] four\n"


@pytest.mark.parametrize("query, column", [("generate_candidates", "error"), ("generate_replies", "reply")])
def test_queries_draw_their_seeds_from_the_exemplars(spark, monkeypatch, query, column):
    from stylograph.plans import queries as Q
    from stylograph.sources.tables import table

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    drawn = P.seeds(table(spark, folder, "exemplars"))
    assert len(drawn) == P.SEEDS
    raises = M.GenerationError

    def answer(system, prompt):
        if column == "error":
            raise raises(prompt)
        return prompt

    monkeypatch.setattr(Q, "_answer", answer)
    lines = "\n".join(f"- {x}" for x in drawn)
    got = [r[column] for r in Q.queries()[query](spark, folder).collect()]
    assert got and all(f"These are {len(drawn)} texts" in x and f"<examples>\n{lines}\n</examples>" in x for x in got)
