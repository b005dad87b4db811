"""Token counts under masks, and the smaller vocabulary of the most frequent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_counts(rows: DataFrame, ids: str = "input_ids", mask: str = "loss_mask", max_length: int | None = None, vocab_size: int | None = None, order: str | None = None) -> DataFrame:
    """``token, n, first_row``: how often each supervised token occurs. ``first_row`` (null without
    ``order``) is the first row of the token, for ties. Ids outside the vocabulary are an error."""
    cut = (lambda c: F.slice(c, 1, max_length)) if max_length else F.col
    pairs = F.arrays_zip(cut(ids).alias("id"), cut(mask).alias("on"))
    at = rows.select((F.col(order) if order else F.lit(None).cast("bigint")).alias("row"), F.explode(pairs).alias("x")).select("row", F.col("x.id").alias("token"), F.col("x.on").alias("on"))
    if vocab_size is not None:
        bad = (F.col("token") < 0) | (F.col("token") >= vocab_size)
        at = at.withColumn("token", F.when(bad, F.raise_error(F.concat(F.lit("token outside target vocab: "), F.col("token")))).otherwise(F.col("token")))
    return at.filter("on = 1").groupBy("token").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))


def top_tokens(counts: DataFrame, size: int, vocab_size: int) -> DataFrame:
    """``draft_id, target_id, shift, n``: the ``size`` most frequent tokens in id order. Ties go to
    the first row, then the lower id; too few tokens are filled up with the lowest unused ids."""
    spark = counts.sparkSession
    known = counts.select("token", "n", "first_row")
    unused = spark.range(vocab_size).select(F.col("id").alias("token")).join(known.select("token"), "token", "left_anti").orderBy("token").limit(size)
    every = known.unionByName(unused.select(F.col("token").cast(known.schema["token"].dataType), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first_row")))
    best = every.orderBy(F.desc("n"), F.asc_nulls_last("first_row"), "token").limit(size)
    at = best.withColumn("draft_id", F.row_number().over(Window.orderBy("token")) - 1)  # at most ``size`` rows
    return at.select("draft_id", F.col("token").alias("target_id"), (F.col("token") - F.col("draft_id")).alias("shift"), "n")


def coverage(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The share of all counted tokens that the mapping holds."""
    kept = counts.join(mapping.select(F.col("target_id").alias("token")), "token", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).crossJoin(kept).withColumn("coverage", F.col("kept") / F.greatest("total", F.lit(1)))  # one row each


def inconsistencies(mapping: DataFrame, members: DataFrame) -> DataFrame:
    """Targets that only one of a mapping (draft_id, shift) and a membership table (target_id,
    member) has; empty if they agree."""
    a = mapping.select((F.col("draft_id") + F.col("shift")).alias("target_id"))
    b = members.filter("member").select("target_id")
    return a.join(b, "target_id", "left_anti").withColumn("only_in", F.lit("mapping")).unionByName(b.join(a, "target_id", "left_anti").withColumn("only_in", F.lit("members")))
