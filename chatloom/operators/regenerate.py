"""Regenerating assistants' turns with a pluggable generator, and serving rows round robin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.validate import conversation_error

#: (messages so far, server) -> (content, reasoning or None); raises on failure.
Generate = Callable[[list[dict], int], tuple[str, str | None]]
MESSAGES = "array<struct<role: string, content: string, reasoning_content: string>>"


def round_robin(rows: DataFrame, servers: int, valid: Column, pos: str) -> DataFrame:
    """Column ``server`` for valid rows by their number among them, from 0."""
    from pyspark.sql import Window

    n = F.sum(F.when(valid, 1).otherwise(0)).over(Window.partitionBy(F.floor(F.col(pos) / 4096)).orderBy(pos))
    block = rows.groupBy(F.floor(F.col(pos) / 4096).alias("__b")).agg(F.count_if(valid).alias("__n"))
    before = block.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row per 4096
    out = rows.withColumn("__b", F.floor(F.col(pos) / 4096)).withColumn("__k", n).join(before, "__b")
    return out.withColumn("server", F.when(valid, F.pmod(F.col("__before") + F.col("__k") - 1, F.lit(servers)).cast("int"))).drop("__b", "__k", "__before")


def regenerate(rows: DataFrame, generate: Generate) -> DataFrame:
    """``id, conversations, status, error``: assistants' messages are dropped, users are replayed in
    order, and each answer is generated from what came before. Invalid rows are ``skipped`` with
    the reason, failures of the generator are ``error``; a failing row stops none other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                said, status, error = [], "success", row.invalid
                if row.invalid is not None:
                    status = "skipped"
                else:
                    try:
                        for m in row.conversations:
                            if m["role"] == "assistant":
                                continue
                            said.append({"role": m["role"], "content": m["content"], "reasoning_content": None})
                            if m["role"] == "user":
                                content, reasoning = generate(said, row.server)
                                said.append({"role": "assistant", "content": content, "reasoning_content": reasoning})
                    except Exception as e:  # the generator is foreign code
                        status, error = "error", str(e)
                out.append((row.id, said, status, error))
            yield pd.DataFrame(out, columns=["id", "conversations", "status", "error"])

    server = F.col("server") if "server" in rows.columns else F.lit(0)
    checked = rows.select("id", "conversations", conversation_error(F.col("conversations"), "regeneration").alias("invalid"), server.alias("server"))
    return checked.mapInPandas(run, f"id string, conversations {MESSAGES}, status string, error string")


def outcome_counts(rows: DataFrame, inputs: int) -> DataFrame:
    """Success, error and skipped rows and the share of success; not adding up is an error."""
    out = rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("success", "error", "skipped")])
    total = F.col("success") + F.col("error") + F.col("skipped")
    checked = F.when(total == inputs, F.col("success") / F.greatest(total, F.lit(1))).otherwise(F.raise_error(F.lit("outcomes don't add up to the inputs")).cast("double"))
    return out.withColumn("success_share", checked)
