"""Mixing to target weights over a tree domain -> language -> source.

Every node's budget is shared among its children by weight; a child never gets more than it
can give (its tokens times the number of epochs), and what it can't give goes to its siblings
by weight before the parent, already held to what all its children give together, can pass
anything on. What lies below a weight of 0 can give nothing, at any level. A leaf's budget is whole epochs and a prefix of one more, in an order seeded by
epoch. All steps are DataFrame operations: a leaf's prefix is found over hash buckets, and
only the bucket that the prefix ends in is ordered row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import materialize

LEVELS = ("domain", "lang", "source")
#: Words as the corpus counts tokens: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of the seeded order, and buckets that are summed together first.
BUCKET_ROWS, TOGETHER = 500, 1024
#: Leaves up to this number (some 10 MB) are broadcast; more are joined by shuffles.
BROADCAST_LEAVES = 100_000


def weight_of(weights: dict[str, int], key: Column, other: int = 1) -> Column:
    """The weight of a node's key, a whole number; keys without one have ``other``."""
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(key == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def share(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Column ``got``: how much of the parent's ``budget`` each child gets.

    ``children`` has ``parent`` and ``key`` columns, ``w``, ``cap`` and ``budget`` (the same
    for siblings, at most the sum of their caps). Whole numbers only; what rounding leaves
    over is dealt by the order of cap / w, then key, so that siblings' parts sum to the budget."""
    at = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    live = children.withColumn("w", F.when(F.col("cap") > 0, F.col("w")).otherwise(0))
    order = at.orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).asc_nulls_last(), F.col(key))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    live = live.withColumn("__spent", F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap"))).over(before), F.lit(0))).withColumn("__rest", F.sum("w").over(after))
    full = (F.col("w") > 0) & (F.col("cap").cast("decimal(20,0)") * F.col("__rest").cast("decimal(18,0)") <= F.col("w").cast("decimal(18,0)") * (F.col("budget") - F.col("__spent")).cast("decimal(20,0)"))
    live = live.withColumn("__full", full)
    live = live.withColumn("__left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(at), F.lit(0)))
    live = live.withColumn("__open", F.when(F.col("__full"), 0).otherwise(F.col("w")))
    live = live.withColumn("__sum", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__all", F.sum("__open").over(at))
    part = F.expr("cast((cast(__left as decimal(20,0)) * cast(__sum as decimal(18,0))) div cast(__all as decimal(18,0)) - (cast(__left as decimal(20,0)) * cast(__sum - __open as decimal(18,0))) div cast(__all as decimal(18,0)) as bigint)")
    got = F.when(F.col("__full"), F.col("cap")).when((F.col("w") > 0) & (F.col("__all") > 0), part).otherwise(F.lit(0))
    return live.withColumn("got", got.cast("long")).drop("__spent", "__rest", "__full", "__left", "__open", "__sum", "__all")


def budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """Column ``got`` for each leaf (``domain, lang, source, tokens``) under a total budget."""
    live = reduce(lambda a, b: a & b, [weight_of(weights.get(level, {}), F.col(level)) > 0 for level in LEVELS])
    caps = leaves.withColumn("cap", F.when(live, F.col("tokens") * max_epochs).otherwise(0).cast("long"))
    nodes = caps.groupBy("domain").agg(F.sum("cap").alias("cap"))
    nodes = nodes.withColumn("budget", F.least(F.sum("cap").over(Window.partitionBy(F.lit(0))), F.lit(total).cast("long")))
    parent: list[str] = []
    for level in LEVELS:
        nodes = share(nodes.withColumn("w", weight_of(weights.get(level, {}), F.col(level))), parent, level)
        parent = parent + [level]
        below = LEVELS[len(parent)] if len(parent) < len(LEVELS) else None
        if below:
            down = caps.groupBy(*parent, below).agg(F.sum("cap").alias("cap"))
            nodes = down.join(nodes.select(*parent, F.col("got").alias("budget")), parent)
    return leaves.join(nodes.select(*LEVELS, "got"), list(LEVELS))


def _sums_before(sums: DataFrame) -> DataFrame:
    """Column ``before``: what a leaf's buckets below hold together. Buckets are summed by
    TOGETHER first, so that no leaf's buckets all meet in one task."""
    sums = sums.withColumn("part", F.expr(f"bucket div {TOGETHER}"))
    below = lambda name, *by: F.coalesce(F.sum(name).over(Window.partitionBy(*LEVELS, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy(*LEVELS, "part").agg(F.sum("held").alias("whole"))
    parts = parts.select(*LEVELS, "part", below("whole", "part").alias("base"))
    within = sums.select(*LEVELS, "bucket", "part", "held", below("held", "part", "bucket").alias("own"))
    return within.join(parts, [*LEVELS, "part"]).select(*LEVELS, "bucket", "held", (F.col("base") + F.col("own")).alias("before"))


def mix(docs: DataFrame, total: int | float, weights: dict[str, dict[str, int]], domain: Column, seed: int = 0, max_epochs: int = 1, text: str = "text") -> DataFrame:
    """The rows that a mixture takes: ``doc_id, domain, lang, source, epoch, n_tokens,
    take_tokens``, one for each epoch in which a row is taken.

    ``total`` is a number of tokens, or as a float a share of the corpus's tokens; tokens are
    words. ``weights`` has whole-number weights for each level's keys (1 for others, 0 or less
    takes nothing and leaves its share to the siblings). Null languages and sources count as ``''``. In epoch e a leaf's rows are ordered
    by md5 of ``seed:e:doc_id``, then doc_id, tokens and text; ``take_tokens`` is below
    ``n_tokens`` only in the row that a prefix ends in. Rows without words (null or empty
    texts) hold no token and are not taken. Repeated rows count each on their own; an empty
    table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(domain, F.lit("")).alias("domain"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS[1:]], F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_tokens"), F.crc32(body.cast("binary")).alias("crc"))
    rows = materialize(rows.filter("n_tokens > 0"), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    if isinstance(total, float):
        total = int((rows.agg(F.sum("n_tokens")).first()[0] or 0) * total)
    plan = budgets(leaves, total, weights, max_epochs).withColumns({"epochs": F.expr("got div tokens"), "prefix": F.expr("got % tokens"), "buckets": F.ceil(F.col("docs") / BUCKET_ROWS)})
    plan = materialize(plan.select(*LEVELS, "epochs", "prefix", "buckets"), "mix-plan")
    named = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan, list(LEVELS))
    whole = named.filter("epochs > 0").select("doc_id", *LEVELS, F.explode(F.expr("sequence(0, cast(epochs - 1 as int))")).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    last = named.filter("prefix > 0").withColumn("epoch", F.col("epochs").cast("int")).drop("epochs")
    last = last.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col("doc_id")).cast("binary")))
    last = last.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("buckets") / (1 << 32)).cast("int"))
    sums = last.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"))
    last = last.join(_sums_before(sums), [*LEVELS, "bucket"]).filter("before < prefix")
    fits = F.col("before") + F.col("held") <= F.col("prefix")
    head = last.filter(fits).withColumn("take_tokens", F.col("n_tokens"))
    order = Window.partitionBy(*LEVELS, "bucket").orderBy("h", "doc_id", "n_tokens", "crc").rowsBetween(Window.unboundedPreceding, -1)
    edge = last.filter(~fits).withColumn("__upto", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    edge = edge.filter(F.col("__upto") < F.col("prefix")).withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("prefix") - F.col("__upto")))
    columns = ["doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens"]
    return whole.select(columns).unionByName(head.select(columns)).unionByName(edge.select(columns))
