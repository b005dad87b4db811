"""Messages of many dialects to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.text import falsy, strip


def normalize_message(m: Column, fields: list[str]) -> Column:
    """``role`` (from ``role`` or ``from``; human and gpt renamed) and ``content`` (the first of
    ``content`` and ``value`` that isn't empty, else ''); other fields stay."""
    role = F.coalesce(*[m[f] for f in ("role", "from") if f in fields], F.lit(""))
    role = F.when(role.isin("human", "user"), "user").when(role.isin("gpt", "assistant"), "assistant").otherwise(role)
    content = F.coalesce(*[falsy(m[f]) for f in ("content", "value") if f in fields], F.lit(""))
    rest = [m[f].alias(f) for f in fields if f not in ("role", "from", "content", "value")]
    return F.struct(role.alias("role"), content.alias("content"), *rest)


def normalize_messages(messages: Column, fields: list[str]) -> Column:
    return F.transform(messages, lambda m: normalize_message(m, fields))


TOOL_CALL = "array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>"


def tool_calls(c: Column) -> Column:
    """Tool calls from JSON text: only id, type and function, with defaults; arguments stay JSON
    text, an object's or a string's that holds one ({} where it holds none). Entries that are no
    objects go; null where the text is no JSON array."""
    calls = F.from_json(F.when(F.try_parse_json(c).isNotNull() & F.startswith(strip(c), F.lit("[")), c), "array<string>")

    def one(x: Column) -> Column:
        function = F.get_json_object(x, "$.function")
        arguments = F.get_json_object(x, "$.function.arguments")
        arguments = F.when(F.try_parse_json(arguments).isNotNull(), arguments).otherwise(F.lit("{}"))
        named = F.struct(F.coalesce(F.get_json_object(x, "$.function.name"), F.lit("")).alias("name"), arguments.alias("arguments"))
        return F.struct(
            F.coalesce(F.get_json_object(x, "$.id"), F.lit("")).alias("id"),
            F.coalesce(F.get_json_object(x, "$.type"), F.lit("function")).alias("type"),
            F.when(function.isNull() | F.startswith(function, F.lit("{")), named).alias("function"),
        )

    return F.transform(F.filter(calls, lambda x: F.startswith(strip(x), F.lit("{"))), one)


def json_list(c: Column) -> Column:
    """A list of JSON texts from one; [] where it is null or no array."""
    ok = F.try_parse_json(c).isNotNull() & F.startswith(strip(c), F.lit("["))
    return F.coalesce(F.from_json(F.when(ok, c), "array<string>"), F.array().cast("array<string>"))


CHANNEL = r"(?s)<\|channel\|>(.*?)<\|message\|>(.*?)<\|end\|>"


def channels(content: Column) -> Column:
    """``channel, content`` of each tagged segment; text without tags is one of channel text."""
    names, bodies = (F.regexp_extract_all(content, F.lit(CHANNEL), F.lit(i)) for i in (1, 2))
    found = F.zip_with(names, bodies, lambda n, b: F.struct(strip(n).alias("channel"), strip(b).alias("content")))
    return F.when(F.size(names) > 0, found).otherwise(F.array(F.struct(F.lit("text").alias("channel"), content.alias("content"))))


def split_channels(messages: Column) -> Column:
    """A message ``role, channel, content`` for every segment of every message."""
    return F.flatten(F.transform(messages, lambda m: F.transform(channels(F.coalesce(m["content"], F.lit(""))), lambda s: F.struct(m["role"].alias("role"), s["channel"].alias("channel"), s["content"].alias("content")))))


def first_of(columns: list[str], *names: str) -> Column:
    """The first of the named columns that the input has and that isn't null."""
    there = [F.col(n) for n in names if n in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def option_lines(text: Column) -> Column:
    """Options after ``Options:``, one per line that begins with a capital and a full stop."""
    after = F.get(F.split(text, "Options:", 2), F.lit(1))
    lines = F.filter(F.transform(F.split(F.coalesce(after, F.lit("")), "\n"), strip), lambda x: F.rlike(x, F.lit(r"^[A-Z]\.")))
    return F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[A-Z]\.", "")))


def few_shot(questions: Column, answers: Column) -> Column:
    """``Question: q\\nAnswer: a\\n\\n`` for each example, joined."""
    return F.array_join(F.zip_with(questions, answers, lambda q, a: F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a, F.lit("\n\n"))), "")


def lettered(options: Column, letters: str = "ABCD") -> Column:
    """``A) first`` and so on, one per line."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.element_at(F.split(F.lit(letters), ""), i + 1), F.lit(") "), o)), "\n")
