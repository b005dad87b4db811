"""From conversations to generation events, and rows set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(message: Column) -> Column:
    """A message as later turns see it: an assistant's without its reasoning."""
    shown = F.when(message["role"] == "assistant", F.lit(None)).otherwise(message["reasoning_content"])
    return message.withField("reasoning_content", shown)


def visible_history(messages: Column) -> Column:
    return F.transform(messages, visible)


def expand_events(rows: DataFrame, index: str = "source_row_index") -> DataFrame:
    """One row per assistant's message: ``id`` (``source#turnK``), ``source_id``, the row's index,
    ``assistant_turn_index`` and the messages up to it, earlier reasoning removed. Rows must be
    valid; see ``quarantine``."""
    m = F.col("conversations")
    turns = F.filter(F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), i.alias("at"))), lambda x: x["role"] == "assistant")
    at = rows.select(F.col("id").alias("source_id"), F.col(index).alias("source_row_index"), "status", m.alias("m"), F.posexplode(turns).alias("assistant_turn_index", "turn"))
    history = F.concat(visible_history(F.slice("m", 1, F.col("turn.at"))), F.slice("m", F.col("turn.at") + 1, 1))
    return at.select(
        F.concat_ws("#turn", "source_id", F.col("assistant_turn_index").cast("string")).alias("id"),
        "source_id", "source_row_index", "assistant_turn_index", history.alias("conversations"), "status",
    )


def quarantine(rows: DataFrame, error: Column, status: str = "skipped") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with ``status`` and ``error``."""
    marked = rows.withColumn("error", error)
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL").withColumn("status", F.lit(status))


def expansion_stats(rows: DataFrame, events: DataFrame, skipped: DataFrame) -> DataFrame:
    """Input, output and skipped rows, turns, conversations of several turns, events per row."""
    per = events.groupBy("source_row_index").agg(F.count("*").alias("n"))
    made = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("output_rows"), F.count_if(F.col("n") > 1).alias("multi_turn_rows"), F.avg("n").alias("avg_events"))
    counts = rows.agg(F.count("*").alias("input_rows")).crossJoin(skipped.agg(F.count("*").alias("skipped_rows")))  # one row each
    return counts.crossJoin(made)
