"""Order, splits, shards, batches and windows by position.

Global positions come from sums over hash or range buckets, so no row set is sorted in one
task; see ``positions``."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import materialize

#: Buckets of the seeded order: a bucket's rows are ordered within one task.
BUCKETS = 4096


#: Range partitions or blocks whose counts (some 100 MB) are broadcast.
BROADCAST_PARTS = 1_000_000


def starts(parts: DataFrame, *order: str) -> DataFrame:
    """Column ``__before``: the rows ``__n`` of all parts before in ``order``. Parts are few: range
    partitions or blocks of files."""
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("__before", F.coalesce(before, F.lit(0)))


def ordered(rows: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Number rows from 0 in any order. They are range-partitioned and sorted within, so ties of
    all of ``order`` stay together: add columns until none is left to fall in one task. Written
    before they are numbered, so that numbers don't change when a task runs again."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    return _from_parts(materialize(at, "ordered"), name)


def _from_parts(rows: DataFrame, name: str) -> DataFrame:
    rows = rows.withColumn("__p", F.shiftright("__m", 33))
    parts = starts(rows.groupBy("__p").agg(F.count("*").alias("__n")), "__p").drop("__n")
    within = F.col("__m") - F.shiftleft("__p", 33)
    return rows.join(F.broadcast(parts), "__p").withColumn(name, F.col("__before") + within).drop("__m", "__p", "__before")  # a row for each partition


def in_file_order(rows: DataFrame, name: str = "pos", start: int = 0) -> DataFrame:
    """Number the rows of a scan of files from ``start``, in the order of the files' paths and of
    places in them, however Spark cuts and packs the files. Nothing is moved: a block's start is
    the number of rows of all blocks before it."""
    at = rows.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s"), F.monotonically_increasing_id().alias("__m"))
    blocks = at.groupBy("__f", "__s").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    blocks = materialize(starts(blocks, "__f", "__s").drop("__n"), "blocks")
    few = blocks.count() <= BROADCAST_PARTS
    out = at.join(F.broadcast(blocks) if few else blocks, ["__f", "__s"])
    return out.withColumn(name, F.col("__before") + F.col("__m") - F.col("__first") + start).drop("__f", "__s", "__m", "__before", "__first")


def seeded_key(seed: int, key: Column) -> Column:
    """A pseudo-random order that any engine can repeat: md5 of ``seed:key``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def positions(rows: DataFrame, order: Column, ties: list[str], bucket: Column, name: str = "pos") -> DataFrame:
    """Number rows from 0 in the order of (order, ties). ``bucket`` is a whole number that grows
    with the order; rows are counted by bucket, and ordered within theirs."""
    rows = rows.withColumns({"__o": order, "__b": bucket})
    sums = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__b", before.alias("__before"))  # at most as many rows as buckets
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__o", *ties)) - 1
    return rows.join(F.broadcast(sums), "__b").withColumn(name, (F.col("__before") + within).cast("bigint")).drop("__o", "__b", "__before")


def shuffled(rows: DataFrame, seed: int, key: str, name: str = "pos") -> DataFrame:
    """Positions in the seeded order."""
    h = seeded_key(seed, F.col(key))
    return positions(rows, h, [key], F.conv(F.substring(h, 1, int(math.log(BUCKETS, 16))), 16, 10).cast("int"), name)


def in_key_order(rows: DataFrame, key: str, low: int, high: int, name: str = "pos") -> DataFrame:
    """Positions in the order of a whole-number key between ``low`` and ``high``."""
    width = max(1, (high - low) // BUCKETS + 1)
    return positions(rows, F.col(key), [], F.floor((F.col(key) - low) / width).cast("int"), name)


def split(rows: DataFrame, seed: int, key: str, share: float = 0.05) -> DataFrame:
    """Column ``split``: ``test`` for ceil(share * n) rows, else ``train``."""
    n = rows.count()
    return shuffled(rows, seed, key).withColumn("split", F.when(F.col("pos") < math.ceil(share * n), "test").otherwise("train")).drop("pos")


def sharded(rows: DataFrame, seed: int, key: str, ranks: int, name: str = "pos") -> DataFrame:
    """Rows dealt to ranks by stride of the seeded order. Where the number isn't a multiple of
    ``ranks`` the first rows are dealt again (all of them several times, if they are few)."""
    n = rows.count()
    want = math.ceil(n / ranks) * ranks if n else 0
    at = shuffled(rows, seed, key, name)
    again = at
    if n:
        copies = F.expr(f"CASE WHEN {name} < {want - 1} + 1 THEN sequence({name}, {want - 1}, {n}) END")
        again = at.withColumn(name, F.explode(copies))
    return again.withColumn("rank", F.pmod(F.col(name), F.lit(ranks)).cast("int"))


def contiguous(rows: DataFrame, n: int, ranks: int, pos: str = "pos") -> DataFrame:
    """Column ``rank``: contiguous parts, one more row each for the first n % ranks."""
    base, extra = divmod(n, ranks)
    edge = extra * (base + 1)
    rank = F.when(F.col(pos) < edge, F.floor(F.col(pos) / (base + 1))).otherwise(extra + F.floor((F.col(pos) - edge) / max(1, base)))
    return rows.withColumn("rank", rank.cast("int"))


def batch_slices(rows: DataFrame, batch: int, ranks: int, pos: str = "pos") -> DataFrame:
    """Columns ``batch, rank``: each batch cut into equal contiguous parts."""
    if batch % ranks:
        raise ValueError("the batch must be a multiple of the ranks")
    return rows.withColumns({"batch": F.floor(F.col(pos) / batch), "rank": F.floor(F.pmod(F.col(pos), F.lit(batch)) / (batch // ranks)).cast("int")})


def batches(rows: DataFrame, size: int, n: int, drop_last: bool = False, skip: int = 0, pos: str = "pos") -> DataFrame:
    """Column ``batch``: ``size`` rows each; without the incomplete last one if ``drop_last``, and
    from batch ``skip`` on. Skipping beyond the last batch is an error."""
    count = n // size if drop_last else math.ceil(n / size)
    if not 0 <= skip <= count:
        raise ValueError(f"there are {count} batches")
    return rows.withColumn("batch", F.floor(F.col(pos) / size)).filter(F.col("batch").between(skip, count - 1))


def windows(rows: DataFrame, ranks: int, per_rank: int, n: int, pos: str = "pos") -> DataFrame:
    """Count windows of ranks * per_rank rows, dealt round robin; ``state`` is ``dispatched``, or
    ``dropped`` for the rows of a window that never fills."""
    size = ranks * per_rank
    whole = n // size * size
    return rows.withColumns({
        "window": F.floor(F.col(pos) / size), "rank": F.pmod(F.pmod(F.col(pos), F.lit(size)), F.lit(ranks)).cast("int"),
        "state": F.when(F.col(pos) < whole, "dispatched").otherwise("dropped"),
    })


def total_steps(rows: int, batch: int, epochs: int, accumulation: int) -> int:
    """Optimizer steps: whole batches of an epoch, times epochs, by accumulation."""
    return rows // batch * epochs // accumulation


def online_steps(rows: int, epochs: int, ranks: int, batch: int, accumulation: int) -> int:
    return rows * epochs // (ranks * batch * accumulation)


def accumulation_plan(batches_: int, accumulation: int) -> int:
    """Steps of a fixed plan; a remainder is an error."""
    if batches_ % accumulation:
        raise ValueError(f"{batches_} batches aren't a multiple of {accumulation}")
    return batches_ // accumulation


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of each group without replacement, in the order of ``key``. Only the k least
    hashes of every task's part of a group are moved."""
    h = seeded_key(seed, F.concat_ws(":", F.col(group), F.col(key)))
    return rows.withColumn("__h", h).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__h", key))).filter(F.col("__r") <= k).drop("__h", "__r")


def nested_depths(rows: DataFrame, group: str, pos: str, depths: int, ratio: float, least: float, seed: int) -> DataFrame:
    """Positions drawn depth by depth: at depth d at most max(ratio**d, least) of the group's
    positions, out of those whose predecessor was drawn at depth d - 1. Column ``depth``."""
    n = F.count("*").over(Window.partitionBy(group))
    now = rows.select(group, pos).withColumn("n", n).withColumn("depth", F.lit(0))
    out = now
    for d in range(1, depths):
        able = now.select(group, (F.col(pos) + 1).alias(pos)).join(rows.select(group, pos).withColumn("n", n), [group, pos])
        h = seeded_key(seed + d, F.concat_ws(":", F.col(group), F.col(pos)))
        rank = F.row_number().over(Window.partitionBy(group).orderBy(h, pos))
        now = able.withColumn("__r", rank).filter(F.col("__r") <= F.floor(F.col("n") * max(ratio**d, least))).drop("__r").withColumn("depth", F.lit(d)).select(group, pos, "n", "depth")
        out = out.unionByName(now)
    return out.drop("n")


def retained(checkpoints: DataFrame, newest: int, step: str = "step", best: str = "is_best") -> DataFrame:
    """The newest checkpoints and the best one (several if they are equally good)."""
    edge = checkpoints.select(F.col(step).alias("__step")).orderBy(F.desc("__step")).limit(newest).agg(F.min("__step").alias("__from"))
    at = checkpoints.crossJoin(F.broadcast(edge))  # one row
    return at.filter((F.col(step) >= F.col("__from")) | F.col(best)).drop("__from")


def accepted(rows: DataFrame, predicate: Callable[[list], bool], column: str = "loss_mask") -> DataFrame:
    """The rows whose array a function from outside accepts, in Arrow batches. What built-in
    functions can say is better given as a Column to ``filter``."""

    @F.pandas_udf("boolean")
    def accepts(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: a is not None and bool(predicate(list(a))))

    return rows.filter(accepts(column))


def accepted_cap(rows: DataFrame, cap: int, keep: Column, order: str) -> DataFrame:
    """The first ``cap`` rows that pass ``keep``: filtered before they are counted."""
    return rows.filter(keep).orderBy(order).limit(cap)
