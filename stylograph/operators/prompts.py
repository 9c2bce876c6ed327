"""Prompts for the model stages, as Column expressions; conversation history by windows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stylograph.functions.text import bullets

NONE_YET = "(none yet)"
SEEDS = 20

CANDIDATES = """Task: propose {n} posts for the situation below, no two alike in opening or length. The style guide sets the limits.

These are {k} texts by the person you write for. Copy their manner, leave their subjects:
<examples>
{exemplars}
</examples>

Situation:
<context>
{context}
</context>

Do not invent specific facts: a name, a number or an event may appear only if the situation or an example has it. Prefer something plain to something untrue.

Output: one JSON array holding the posts as strings, no other text.
"""
REPLY = """Task: one chat message in the manner of the person below, within the style guide.

These are {k} texts by that person. Copy their manner, leave their subjects:
<examples>
{exemplars}
</examples>

Earlier turns, first to last:
<history>
{history}
</history>

{author} now said:
<message>
{message}
</message>

Do not invent specific facts, and do not take the examples for news: what they tell may be long past. If you do not know, be vague or talk of something else.

Output: the bare message, short, unquoted, without comment.
"""
FACTS_SYSTEM = (
    "You note what stays true about people. Given a message and the notes on its sender, list what the message adds that will still hold next month. "
    "Skip moods, chat and anything noted before. Write the sender's given name, never as 'the author' or 'the user'."
)
FACTS = """Notes on {author}:
<known>
{known}
</known>

{author} now said:
<message>
{message}
</message>

Output: a JSON array of new notes, [] if there are none, no other text. Each note uses the name "{author}", never "the author" or "the user".
"""
INTERJECT_SYSTEM = (
    "You watch a group chat for one of its members and say when that member should join in. Mostly the answer is no: others may talk among themselves. "
    "It is yes for a question to everyone, for a claim that calls for an answer, or where the member knows more than has been said."
)
INTERJECT = """Earlier turns, first to last:
<history>
{history}
</history>

{author} now said:
<message>
{message}
</message>

Output: the word INTERJECT if the member should join in, else the word SILENT.
"""


def fill(template: str, **values: Column | str | int) -> Column:
    """The template with its {names} replaced by columns or literals; a null value counts as empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        value = values[name]
        parts.append(F.coalesce(value.cast("string"), F.lit("")) if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


def history(turns: Column) -> Column:
    """Lines of an array of (speaker, text), or a note that there is none."""
    lines = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("- "), F.coalesce(t["speaker"], F.lit("")), F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")
    return F.when(F.size(turns) > 0, lines).otherwise(F.lit(NONE_YET))


def with_history(df: DataFrame, conversation: list[str], turn: str, speaker: str = "speaker", text: str = "text", turns: int | None = None) -> DataFrame:
    """`df` with `history`: all earlier turns of the row's conversation as text, or only the last `turns` of them if the caller says so.

    A conversation is ordered within one task, so its columns should bound it (a channel and a day, say).
    """
    window = Window.partitionBy(*conversation).orderBy(turn)
    before = window.rowsBetween(Window.unboundedPreceding if turns is None else -turns, -1)
    earlier = F.collect_list(F.struct(F.col(speaker).alias("speaker"), F.col(text).alias("text"))).over(before)
    return df.withColumn("history", history(earlier))


def seed_rows(exemplars: DataFrame, k: int = SEEDS, seed: int = 0, text_col: str = "text") -> DataFrame:
    """(rank, text) of `k` exemplars (or all, if fewer), drawn without replacement by a seeded order. Null texts are never drawn."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(text_col)))
    rows = exemplars.where(F.col(text_col).isNotNull()).select(key.alias("_key"), F.col(text_col).alias("text")).orderBy("_key", "text").limit(k)
    return rows.select((F.row_number().over(Window.orderBy("_key", "text")) - 1).alias("rank"), "text")  # k rows


def seeds(exemplars: DataFrame | list[str], k: int = SEEDS, seed: int = 0, text_col: str = "text") -> list[str]:
    """The texts of `seed_rows`, also of a plain list."""
    if isinstance(exemplars, DataFrame):
        return [r.text for r in seed_rows(exemplars, k, seed, text_col).orderBy("rank").collect()]
    return sorted(exemplars, key=lambda t: (hashlib.md5(f"{seed}:{t}".encode()).hexdigest(), t))[:k]


def candidates_prompt(context: Column, exemplars: list[str], n: int) -> Column:
    return fill(CANDIDATES, k=len(exemplars), exemplars="\n".join(f"- {x}" for x in exemplars), n=n, context=context)


def reply_prompt(message: Column, author: Column, past: Column, exemplars: list[str]) -> Column:
    return fill(REPLY, k=len(exemplars), exemplars="\n".join(f"- {x}" for x in exemplars), history=past, message=message, author=author)


def facts_prompt(message: Column, author: Column, known: Column) -> Column:
    return fill(FACTS, author=author, message=message, known=F.when(F.size(known) > 0, bullets(known)).otherwise(F.lit(NONE_YET)))


def interject_prompt(message: Column, author: Column, past: Column) -> Column:
    return fill(INTERJECT, author=author, message=message, history=past)
