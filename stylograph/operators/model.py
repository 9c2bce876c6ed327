"""Model stages: one request a row through an exchangeable client, answers parsed by Arrow functions.

A failed request or an answer that cannot be used gives its reason in the `error` column; one bad row never ends a
job. Spark may repeat a task and with it requests: switch speculation off for such jobs.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylograph.functions import text as X
from stylograph.operators import prompts
from stylograph.plans.scale import stage


class GenerationError(Exception):
    """The model could not be reached, or its answer cannot be used."""


@dataclass(frozen=True)
class Request:
    """Where and how to ask; the key is read where it is used and is in no plan. `extra_body` goes into every request."""

    model: str
    base_url: str
    api_key_env: str = "MODEL_API_KEY"
    extra_body: dict = field(default_factory=dict)
    timeout: float = 120.0


#: A client takes (system, prompt, further fields of the request) and returns the answer, or raises GenerationError.
Client = Callable[[str, str, dict], str]
#: Makes one client for a partition. Its `check`, if it has one, is called on the driver before a job starts, and raises GenerationError.
ClientFactory = Callable[[], Client]


def answer_text(response: dict) -> str:
    """The stripped text of a chat-completions response; an empty choice list is an error."""
    choices = response.get("choices") or []
    if not choices:
        raise GenerationError("the model returned no choices")
    return ((choices[0].get("message") or {}).get("content") or "").strip()


@dataclass(frozen=True)
class HttpClients:
    """Clients of a chat-completions service, one for each partition."""

    request: Request

    def check(self) -> str:
        key = os.environ.get(self.request.api_key_env, "")
        if not key:
            raise GenerationError("no API key configured")
        return key

    def body(self, system: str, prompt: str, fields: dict) -> dict:
        """The request; the caller's `extra_body` overrides the stage's own fields."""
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        return {"model": self.request.model, "messages": messages, **fields, **self.request.extra_body}

    def __call__(self) -> Client:
        key = self.check()

        def ask(system: str, prompt: str, fields: dict) -> str:
            call = urllib.request.Request(self.request.base_url.rstrip("/") + "/chat/completions", json.dumps(self.body(system, prompt, fields)).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            try:
                with urllib.request.urlopen(call, timeout=self.request.timeout) as response:
                    return answer_text(json.load(response))
            except (OSError, ValueError) as error:
                raise GenerationError(str(error)) from error

        return ask


def http_client(request: Request) -> HttpClients:
    return HttpClients(request)


def fake_client(answer: Callable[[str, str], str]) -> ClientFactory:
    """Clients that answer by a plain function of system and prompt, for tests and dry runs."""
    return lambda: lambda system, prompt, fields: answer(system, prompt)


def checked(client: ClientFactory, exemplars: list[str] | None = None) -> None:
    """GenerationError, before any job, for a client that cannot work or for an empty list of exemplars."""
    check = getattr(client, "check", None)
    if check:
        check()
    if exemplars is not None and not exemplars:
        raise GenerationError("no exemplars supplied")


def ask(df: DataFrame, client: ClientFactory, system: str, prompt_col: str = "prompt", fields: dict | None = None) -> DataFrame:
    """`df` with `answer` and `error`, one request for each row; `fields` go into every request."""
    fields = dict(fields or {})
    schema = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call: Client | None = None
        for batch in batches:
            answers, errors = [], []
            for prompt in batch.column(prompt_col).to_pylist():
                try:
                    call = call or client()
                    answers.append((call(system, prompt or "", fields) or "").strip())
                    errors.append(None)
                except GenerationError as error:
                    answers.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "answer", "error"])

    return df.mapInArrow(run, schema)


def _without_fence(text: str) -> str:
    if not text.startswith("```"):
        return text
    head, line, rest = text.partition("\n")
    if not line:
        raise GenerationError("a fence without a line of its own")
    inside, fence, _ = rest.rpartition("```")
    return inside if fence else rest


def _kept(values: list) -> list[str]:
    return [v.strip() for v in values if isinstance(v, str) and v.strip()]


def candidates_of(text: str) -> list[str]:
    """Strings of one or more JSON arrays (or bare values) one after another; GenerationError for anything else."""
    rest, values = _without_fence(text).strip(), []
    decoder = json.JSONDecoder()
    while rest:
        try:
            value, end = decoder.raw_decode(rest)
        except ValueError as error:
            raise GenerationError(f"the answer is no JSON: {text[:200]}") from error
        values += value if isinstance(value, list) else [value]
        rest = rest[end:].lstrip()
    return _kept(values)


def facts_of(text: str) -> list[str]:
    """Strings of exactly one JSON array; GenerationError for anything else, also for a blank answer."""
    try:
        value = json.loads(_without_fence(text))
    except ValueError as error:
        raise GenerationError(f"the answer is no JSON: {text[:200]}") from error
    if not isinstance(value, list):
        raise GenerationError("the answer is no JSON array")
    return _kept(value)


def _parser(parse: Callable[[str], list[str]]):
    @F.arrow_udf("values array<string>, error string")
    def run(texts: pa.Array) -> pa.Array:
        values, errors = [], []
        for text in texts.to_pylist():
            try:
                values.append(parse(text) if text is not None else None)
                errors.append(None)
            except GenerationError as error:
                values.append(None)
                errors.append(str(error))
        return pa.StructArray.from_arrays([pa.array(values, pa.list_(pa.string())), pa.array(errors, pa.string())], names=["values", "error"])

    return run


def parse_candidates(text: Column | str) -> Column:
    """Struct (values, error) of answers with candidates; null for null."""
    return _parser(candidates_of)(text)


def parse_facts(text: Column | str) -> Column:
    """Struct (values, error) of answers with facts; null for null."""
    return _parser(facts_of)(text)


def _parsed(asked: DataFrame, parser: Callable[[Column | str], Column], out: str) -> DataFrame:
    """The answers are staged before they are parsed, so that reading the result again asks nothing again."""
    rows = stage(asked).withColumn("_p", parser("answer"))
    return rows.withColumn(out, F.col("_p.values")).withColumn("error", F.coalesce("error", F.col("_p.error"))).drop("_p", "answer", "prompt")


def generate_candidates(df: DataFrame, client: ClientFactory, style_guide: str, exemplars: list[str] | DataFrame, count: int = 6, context_col: str = "context", seed_count: int = prompts.SEEDS, seed: int = 0) -> DataFrame:
    """`df` with `candidates` and `error`. `seed_count` of the exemplars, drawn by `seed`, go into each prompt."""
    drawn = prompts.seeds(exemplars, seed_count, seed)
    checked(client, drawn)
    asked = ask(df.withColumn("prompt", prompts.candidates_prompt(F.col(context_col), drawn, count)), client, style_guide)
    return _parsed(asked, parse_candidates, "candidates")


def generate_replies(df: DataFrame, client: ClientFactory, style_guide: str, exemplars: list[str] | DataFrame, message: str = "text", author: str = "speaker", history: str = "history", seed_count: int = prompts.SEEDS, seed: int = 0) -> DataFrame:
    """`df` with `reply` and `error`. `seed_count` of the exemplars, drawn by `seed`, go into each prompt."""
    drawn = prompts.seeds(exemplars, seed_count, seed)
    checked(client, drawn)
    prompt = prompts.reply_prompt(F.col(message), F.col(author), F.col(history), drawn)
    return stage(ask(df.withColumn("prompt", prompt), client, style_guide)).withColumn("reply", X.strip_quotes(F.col("answer"))).drop("answer", "prompt")


def extract_facts(df: DataFrame, client: ClientFactory, message: str = "text", author: str = "speaker", known: str = "known") -> DataFrame:
    """`df` with `facts` and `error`."""
    checked(client)
    prompt = prompts.facts_prompt(F.col(message), F.col(author), F.col(known))
    return _parsed(ask(df.withColumn("prompt", prompt), client, prompts.FACTS_SYSTEM), parse_facts, "facts")


def should_interject(df: DataFrame, client: ClientFactory, message: str = "text", author: str = "speaker", history: str = "history") -> DataFrame:
    """`df` with `interject` and `error`; only an answer that starts with INTERJECT says yes. The request is short and steady (`interject_body`),
    unless the client's own fields say otherwise; a missing key is each row's error, as in a stage that only decides."""
    prompt = prompts.interject_prompt(F.col(message), F.col(author), F.col(history))
    asked = ask(df.withColumn("prompt", prompt), client, prompts.INTERJECT_SYSTEM, fields=interject_body())
    return stage(asked).withColumn("interject", X.decision(F.col("answer"))).drop("answer", "prompt")


def interject_body(extra_body: dict | None = None) -> dict:
    """Further fields of a decision's request; the caller's override."""
    return {"temperature": 0, "max_tokens": 8, **(extra_body or {})}
