"""Raw datasets to one conversation shape, each a projection without Python rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import falsy, stable_id
from chatloom.operators.order import in_file_order

#: Speakers and the roles that they are.
ROLES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bing": "assistant", "bard": "assistant"}
#: Sets with pictures, which this engine doesn't read.
PICTURE_SETS = ("sharegpt4v", "allava4v")
LETTERS = ("a", "b", "c", "d")


def role_of(speaker: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[speaker]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pair(rows: DataFrame, row_id: Column, user: Column, assistant: Column) -> DataFrame:
    """One question and one answer as a conversation; nothing skipped."""
    return rows.select(row_id.cast("string").alias("id"), F.array(message("user", user), message("assistant", assistant)).alias("conversations"), F.lit(0).alias("skipped"))


def _hashed(user: str, assistant: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: pair(rows, stable_id(F.col(user), F.col(assistant)), F.col(user), F.col(assistant))


def ultrachat(rows: DataFrame) -> DataFrame:
    """Messages as they are; an unknown role is an error."""
    known = F.forall("messages", lambda m: F.coalesce(m["role"].isin("user", "assistant"), F.lit(False)))
    kept = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select(F.col("prompt_id").cast("string").alias("id"), F.when(known, kept).otherwise(F.raise_error(F.lit("Unsupported UltraChat role"))).alias("conversations"), F.lit(0).alias("skipped"))


def sharegpt(rows: DataFrame) -> DataFrame:
    """Speakers become roles; messages of unknown speakers are left out and counted."""
    kept = F.transform(F.filter("conversations", lambda m: role_of(m["from"]).isNotNull()), lambda m: F.struct(role_of(m["from"]).alias("role"), m["value"].alias("content")))
    return rows.select(F.col("id").cast("string").alias("id"), kept.alias("conversations"), (F.size("conversations") - F.size(kept)).alias("skipped"))


def infinity_instruct(rows: DataFrame) -> DataFrame:
    return pair(rows, F.col("id"), F.get("conversation", F.lit(0))["content"], F.col("generated_message.content"))


def code_alpaca(rows: DataFrame) -> DataFrame:
    user = F.when(F.length("input") > 0, F.concat("instruction", F.lit("\n\n"), "input")).otherwise(F.col("instruction"))
    return pair(rows, stable_id(user, F.col("output")), user, F.col("output"))


def open_code_instruct(rows: DataFrame) -> DataFrame:
    given = falsy(F.col("id").cast("string")) if "id" in rows.columns else F.lit(None).cast("string")
    return pair(rows, F.coalesce(given, stable_id(F.col("input"), F.col("output"))), F.col("input"), F.col("output"))


def math_qa(rows: DataFrame) -> DataFrame:
    user = F.concat("Problem", F.lit("\n"), "options")
    return pair(rows, stable_id(user, F.col("Rationale")), user, F.col("Rationale"))


def sciq(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Four answers in an order seeded by question and answer, lettered; the label is that of the
    first that equals the correct one."""
    answers = F.array("distractor3", "distractor1", "distractor2", "correct_answer")
    dealt = F.transform(F.array_sort(F.transform(answers, lambda a, i: F.struct(F.md5(F.concat_ws("\x1f", F.lit(seed).cast("string"), F.col("question"), a).cast("binary")).alias("h"), i.alias("i"), a.alias("a")))), lambda x: x["a"])
    names = F.array(*map(F.lit, LETTERS))
    label = F.element_at(names, F.array_position(dealt, F.col("correct_answer")).cast("int"))
    options = F.array_join(F.transform(F.arrays_zip(names.alias("l"), dealt.alias("a")), lambda x: F.concat(x["l"], F.lit(") "), x["a"])), "\n")
    user = F.concat("question", F.lit("\n"), options)
    assistant = F.concat("support", F.lit("\nanswer: "), label, F.lit(") "), "correct_answer")
    return pair(rows, stable_id(user, assistant), user, assistant)


def identity(rows: DataFrame) -> DataFrame:
    return rows if "skipped" in rows.columns else rows.withColumn("skipped", F.lit(0))


def rename_id(rows: DataFrame, old: str = "uuid") -> DataFrame:
    return rows.withColumnRenamed(old, "id")


def add_index(rows: DataFrame, name: str = "id") -> DataFrame:
    """Rows of a scan of files numbered from 0 in the order of the files and of places in them:
    Spark packs the largest files first, so its partitions are in another order."""
    return in_file_order(rows.drop(name), name)


PRESETS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ultrachat": ultrachat,
    "sharegpt": sharegpt,
    "eaglechat": identity,
    "perfectblend": sharegpt,
    "perfectblend-llama3.1-8b-instruct": identity,
    "perfectblend-llama3.3-70b-instruct": identity,
    "perfectblend-llama4-scout-instruct": identity,
    "perfectblend-llama4-maverick-instruct": identity,
    "magpie-qwen2.5-pro-1m-v0.1": lambda rows: sharegpt(rename_id(rows)),
    "opc": _hashed("instruction", "output"),
    "gsm8k": _hashed("question", "answer"),
    "hendrycks_math": _hashed("problem", "solution"),
    "math_qa": math_qa,
    "codealpaca-20k": code_alpaca,
    "opencodeinstruct": open_code_instruct,
    "magicoder-evol-instruct": _hashed("instruction", "response"),
    "sciq": sciq,
    "camel": _hashed("message_1", "message_2"),
    "nebius-llama31-8b-infinity-instruct": infinity_instruct,
}


def prepare(name: str, rows: DataFrame) -> DataFrame:
    """A named dataset's rows as ``id, conversations, skipped``. Register more in PRESETS."""
    if name in PICTURE_SETS:
        raise ValueError(f"{name} has pictures, which are not supported")
    if name not in PRESETS:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(sorted(PRESETS))}")
    return PRESETS[name](rows)
