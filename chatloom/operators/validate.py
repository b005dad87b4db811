"""Validation of conversations, with the first error of each as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.text import blank, has_think_marker


def nest(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Flat messages (key, order, role, text) to one row per conversation, messages in order."""
    item = F.struct(F.col(order).alias("turn"), F.col("role"), F.col("text").alias("content"))
    rows = messages.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    return rows.select(F.col(key).cast("string").alias("id"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversations"))


def _walk(messages: Column, style: str) -> Column:
    """Fold the messages to (index, role expected next, user seen, first error)."""
    validation = style == "validation"

    def step(acc: Column, m: Column) -> Column:
        i, want, seen = acc["i"], acc["want"], acc["seen"]
        at, role = i.cast("string"), m["role"]
        named = F.coalesce(F.concat(F.lit("'"), role, F.lit("'")), F.lit("None")) if validation else F.coalesce(role, F.lit("None"))
        if validation:
            no_object = F.concat(F.lit("message "), at, F.lit(" must be an object"))
            no_content = F.concat(F.lit("message "), at, F.lit(" content must be a non-empty string"))
            no_role = F.concat(F.lit("message "), at, F.lit(" has unsupported role "), named)
            order = F.concat(F.lit("message "), at, F.lit(" expected role '"), want, F.lit("', got "), named)
        else:
            no_object = F.concat(F.lit("Invalid message at position "), at, F.lit(": expected object"))
            no_content = F.concat(F.lit("Invalid message content at position "), at, F.lit(": expected non-empty string"))
            no_role = F.concat(F.lit("Invalid message role: "), named)
            order = F.when(~seen & (role == "assistant"), F.lit("Data starts with an assistant message")).otherwise(
                F.concat(F.lit("Invalid conversation role order at position "), at, F.lit(": expected "), want, F.lit(", got "), named)
            )
        skipped = F.coalesce((role == "system") & ~seen, F.lit(False))
        known = F.coalesce(role.isin("user", "assistant"), F.lit(False))
        error = F.when(m.isNull(), no_object).when(blank(m["content"]), no_content).when(skipped, F.lit(None)).when(~known, no_role).when(role != want, order)
        turn = known & ~skipped
        return F.struct(
            (i + 1).alias("i"),
            F.when(turn, F.when(role == "user", F.lit("assistant")).otherwise(F.lit("user"))).otherwise(want).alias("want"),
            (seen | turn).alias("seen"),
            F.coalesce(acc["error"], error).alias("error"),
        )

    start = F.struct(F.lit(0).alias("i"), F.lit("user").alias("want"), F.lit(False).alias("seen"), F.lit(None).cast("string").alias("error"))
    return F.aggregate(messages, start, step)


def conversation_error(messages: Column, style: str = "validation") -> Column:
    """The first error of a conversation, null if it is valid: messages with content, ``system``
    only before the first user, then user and assistant in turn. ``style`` picks the texts:
    ``validation`` or ``regeneration``."""
    empty, no_user = ("conversations must be a non-empty list", "conversation has no user message") if style == "validation" else ("Missing or empty conversations list", "Data does not contain a user message")
    end = _walk(messages, style)
    return F.when(messages.isNull() | (F.size(messages) == 0), F.lit(empty)).otherwise(F.coalesce(end["error"], F.when(~end["seen"], F.lit(no_user))))


def _of_assistants(messages: Column, error) -> Column:
    """The first text that ``error(message, index)`` gives for an assistant's message."""
    found = F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", error(m, i.cast("string"))))
    return F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))


def row_error(expect_non_reasoning: bool = False, expect_reasoning: bool = False, strict_think_markers: bool = False) -> Column:
    """The first error of a generated row ``id, status, conversations`` (messages with
    ``reasoning_content``), null if it is valid."""
    if expect_non_reasoning and expect_reasoning:
        raise ValueError("reasoning is either expected or not")
    m = F.col("conversations")

    def of_message(x: Column, i: Column) -> Column:
        name, reasoning = F.concat(F.lit("assistant message "), i), x["reasoning_content"]
        error = F.when(F.lit(expect_non_reasoning) & ~blank(reasoning), F.concat(name, F.lit(" has non-empty reasoning_content")))
        error = error.when(F.lit(expect_reasoning) & blank(reasoning), F.concat(name, F.lit(" has empty reasoning_content")))
        error = error.when(F.lit(strict_think_markers) & has_think_marker(x["content"]), F.concat(name, F.lit(" contains a thinking marker")))
        return error.when(F.lit(strict_think_markers) & has_think_marker(reasoning), F.concat(name, F.lit(" reasoning_content contains a thinking marker")))

    return F.coalesce(
        F.when(blank(F.col("id")), F.lit("id must be a non-empty string")),
        F.when(~F.col("status").eqNullSafe(F.lit("success")), F.lit("status must be 'success'")),
        conversation_error(m),
        _of_assistants(m, of_message),
        F.when(assistant_count(m) == 0, F.lit("conversation has no assistant message")),
        F.when(F.element_at(m, -1)["role"] != "assistant", F.lit("conversation must end with an assistant message")),
    )


def assistant_count(messages: Column) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == "assistant"))


def reasoning_error(messages: Column) -> Column:
    """The first error of a conversation in which every assistant's message has its reasoning."""
    start = F.get(F.filter(F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), i.alias("i"))), lambda x: ~x["role"].eqNullSafe(F.lit("system"))), F.lit(0))
    return F.coalesce(
        F.when(start["role"] == "assistant", F.concat(F.lit("Invalid conversation role order at position "), start["i"], F.lit(": expected user, got assistant"))),
        conversation_error(messages, "regeneration"),
        _of_assistants(messages, lambda m, i: F.when(blank(m["reasoning_content"]), F.concat(F.lit("Invalid assistant reasoning_content at position "), i, F.lit(": expected non-empty string")))),
        F.when(assistant_count(messages) == 0, F.lit("Data does not contain an assistant message")),
        F.when(F.element_at(messages, -1)["role"] != "assistant", F.lit("Conversation ends with a user message")),
    )


def dataset_report(rows: DataFrame, error: Column, line: str = "line") -> DataFrame:
    """One row: rows, assistant_messages, duplicate_rows, first_bad_line, first_error. A dataset
    without rows has the error ``dataset is empty``."""
    checked = rows.withColumn("__error", error)
    bad = F.col("__error").isNotNull()
    out = checked.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.when(~bad, assistant_count(F.col("conversations")))), F.lit(0)).alias("assistant_messages"),
        (F.count("id") - F.count_distinct("id")).alias("duplicate_rows"),
        F.min(F.when(bad, F.col(line))).alias("first_bad_line"),
        F.min_by(F.when(bad, F.col("__error")), F.when(bad, F.col(line))).alias("first_error"),
    )
    return out.withColumn("first_error", F.when(F.col("rows") == 0, F.lit("dataset is empty")).otherwise(F.col("first_error")))


def repair_structure(messages: Column, system_prompt: str | None = None) -> Column:
    """The messages that a parser keeps: a leading system message (or the template's), nothing
    before the first user, and nothing from the first illegal transition on (``tool`` after other
    than assistant or tool, ``assistant`` after other than user or tool)."""
    lead = F.get(messages, F.lit(0))
    own = F.when(lead["role"] == "system", F.slice(messages, 1, 1)).otherwise(F.slice(messages, 1, 0))
    if system_prompt:
        made = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
        own = F.when(lead["role"] == "system", own).otherwise(made)
    rest = F.when(lead["role"] == "system", F.slice(messages, 2, F.size(messages))).otherwise(messages)
    first = F.array_position(F.transform(rest, lambda m: m["role"]), "user")
    body = F.when(first > 0, F.slice(rest, first.cast("int"), F.size(rest))).otherwise(F.slice(rest, 1, 0))

    def illegal(m: Column, i: Column) -> Column:
        before = F.get(body, i - 1)["role"]
        tool = (m["role"] == "tool") & ~before.isin("assistant", "tool")
        answer = (m["role"] == "assistant") & ~before.isin("user", "tool")
        return F.when(i == 0, F.lit(False)).otherwise(F.coalesce(tool | answer, F.lit(False)))

    cut = F.array_position(F.transform(body, illegal), True)
    return F.concat(own, F.when(cut > 0, F.slice(body, 1, (cut - 1).cast("int"))).otherwise(body))


def flat_order_errors(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """F01 on flat messages, without nesting: ``key, error`` for conversations with one. For
    conversations too long to be one row's array."""
    w = Window.partitionBy(key).orderBy(order)
    seen = F.sum(F.when(F.col("role").isin("user", "assistant"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = messages.withColumns({"i": F.row_number().over(w) - 1, "seen": F.coalesce(seen, F.lit(0)) > 0})
    turns = rows.filter(~((F.col("role") == "system") & ~F.col("seen")))
    turns = turns.withColumn("want", F.when(F.lag("role").over(w) == "user", "assistant").otherwise("user"))
    bad = F.when(blank(F.col("text")), F.concat(F.lit("message "), F.col("i"), F.lit(" content must be a non-empty string"))).when(
        ~F.col("role").isin("user", "assistant"), F.concat(F.lit("message "), F.col("i"), F.lit(" has unsupported role '"), F.col("role"), F.lit("'"))
    ).when(F.col("role") != F.col("want"), F.concat(F.lit("message "), F.col("i"), F.lit(" expected role '"), F.col("want"), F.lit("', got '"), F.col("role"), F.lit("'")))
    return turns.withColumn("error", bad).filter("error IS NOT NULL").groupBy(key).agg(F.min_by("error", "i").alias("error"))


def nonempty(messages: Column) -> Column:
    """Whether a source row has any message: empty rows are skipped, not counted as errors."""
    return F.coalesce(F.size(messages) > 0, F.lit(False))
