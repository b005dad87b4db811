"""Sharding by best-fit decreasing: groups of rows that must stay together go, largest first,
into the shard with the least room that still takes them.

Groups of one size are interchangeable, so the packing needs only the histogram of group
sizes. Sizes are packed to BITS significant bits, rounded up: exact below 32 KiB, by at most
1 part in 16,384 above, which is less than the packing's own tolerance. So there are at most
2**(BITS - 1) sizes for each doubling, half a million up to 16 TiB, however large the table.
The histogram is packed on the driver with the shards' rooms in a balanced tree; rows then
find their shard by their group's size and its rank among the groups of that size. Ranks and
slots are prefix sums over hash buckets, so no key's rows meet in one task.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import materialize

#: Significant bits of the sizes that are packed.
BITS = 15
#: Rows of one hash bucket, within which ranks are counted by a window, and buckets that are
#: summed together first.
BUCKET_ROWS, TOGETHER = 500, 1024
#: Counts of up to this number of sizes or shards (some 10 MB) are broadcast.
BROADCAST_SIZES = 200_000


class Rooms:
    """A treap of (room, shard): the tightest room that takes a size, in O(log shards)."""

    def __init__(self, seed: int = 0):
        self.root, self.rng = None, random.Random(seed)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return [node[0], node[1], node[2], left], right
        left, right = self._split(node[2], key)
        return left, [node[0], node[1], right, node[3]]

    def add(self, room: int, shard: int) -> None:
        left, right = self._split(self.root, (room, shard))
        self.root = self._merge(self._merge(left, [(room, shard), self.rng.random(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest room of at least ``size``."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            left, right = self._split(self.root, best)
            _, right = self._split(right, (best[0], best[1] + 1))
            self.root = self._merge(left, right)
        return best


def best_fit(sizes: list[tuple[int, int]], capacity: int, shards: int | None = None, first: int = 0) -> list[tuple[int, int, int]] | None:
    """Runs ``(size, count, shard)`` that place ``sizes`` (size, count), largest first.

    With ``shards`` None a new shard opens when none has room (a size above the capacity gets
    a shard of its own); else None is returned when the shards don't suffice."""
    rooms, opened, runs = Rooms(), first, []
    if shards is not None:
        for s in range(shards):
            rooms.add(capacity, first + s)
    for size, count in sorted(sizes, reverse=True):
        while count:
            best = rooms.take(size)
            if best is None:
                if shards is not None:
                    return None
                best = (max(capacity, size), opened)
                opened += 1
            n = min(count, best[0] // size) if size else count
            runs.append((size, n, best[1]))
            count -= n
            rooms.add(best[0] - n * size, best[1])
    return runs


def pack(sizes: list[tuple[int, int]], shards: int, tolerance: float = 1e-4) -> list[tuple[int, int, int]]:
    """Best-fit decreasing into a fixed number of shards of near equal size: groups larger
    than the fair share get a shard each, the others the least capacity that suffices."""
    left, alone, free = {s: n for s, n in sizes if n}, [], shards
    total = sum(s * n for s, n in left.items())
    for size in sorted(left, reverse=True):
        while left[size] and free > 1 and size * free > total:
            alone.append((size, 1, shards - free))
            left[size] -= 1
            total, free = total - size, free - 1
        if left[size]:
            break
    rest = [(s, n) for s, n in left.items() if n]
    if not rest:
        return alone
    fair, step = math.ceil(total / free), tolerance
    low, runs = fair - 1, best_fit(rest, fair, free, shards - free)
    high = fair
    while runs is None:
        low, high = high, math.ceil(fair * (1 + step)) + 1
        runs, step = best_fit(rest, high, free, shards - free), step * 2
    while high - low > max(1, fair * tolerance):
        middle = (low + high) // 2
        better = best_fit(rest, middle, free, shards - free)
        low, high, runs = (low, middle, better) if better is not None else (middle, high, runs)
    return alone + runs


def _ranked(df: DataFrame, key: str, order: list[Column], salt: Column, rows: DataFrame, few: bool, name: str) -> DataFrame:
    """Add ``name``: the gapless rank of each row among those with its ``key``.

    ``rows`` has the count ``n`` of each key; ``few`` says that its rows were counted and may be
    broadcast, so that no row is dealt by its key alone. A key's rows are dealt to hash buckets of about
    BUCKET_ROWS; a rank is the rows of the buckets before, plus the rank within the bucket."""
    many = rows.select(key, F.ceil(F.col("n") / BUCKET_ROWS).alias("__buckets"))
    df = df.join(F.broadcast(many) if few else many, key).withColumn("__bucket", F.pmod(salt, F.col("__buckets"))).drop("__buckets")
    hot = many.filter("__buckets > 1").drop("__buckets")
    hot = df.join(F.broadcast(hot) if few else hot, key, "left_semi").groupBy(key, "__bucket").count().withColumn("__part", F.expr(f"__bucket div {TOGETHER}"))
    below = lambda name, *by: F.coalesce(F.sum(name).over(Window.partitionBy(key, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = hot.groupBy(key, "__part").agg(F.sum("count").alias("__whole")).select(key, "__part", below("__whole", "__part").alias("__base"))
    hot = hot.select(key, "__bucket", "__part", below("count", "__part", "__bucket").alias("__own")).join(parts, [key, "__part"])
    df = df.join(hot.select(key, "__bucket", (F.col("__base") + F.col("__own")).alias("__before")), [key, "__bucket"], "left")
    within = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)) - 1
    return df.withColumn(name, (within + F.coalesce("__before", F.lit(0))).cast("long")).drop("__bucket", "__before")


def rounded(size: Column) -> Column:
    """``size`` to BITS significant bits, rounded up."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(size)) - BITS, F.lit(0)))
    return F.call_function("div", size + step - 1, step) * step


def shard(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", overhead: int = 16) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard``, under the law ``bytes``.

    A group is all rows of an equal text (a null text counts as an empty one) and never
    splits. A size is the text's UTF-8 bytes plus ``overhead``; a group's is the sum over its
    rows. Groups above the fair share take a shard each. Slots count a shard's rows from 0
    without gaps. Repeated rows get a slot each; an empty table gives no rows; other columns
    are neither read nor returned. ``grown_shard`` is null: this law moves rows when the
    number of shards changes.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("g"))
    base = materialize(base, "shard-rows")
    groups = base.groupBy("g").agg(rounded(F.sum("size")).alias("gsize"))
    counts = groups.groupBy("gsize").agg(F.count("*").alias("n"))
    sizes = [(r["gsize"], r["n"]) for r in counts.collect()]  # bounded by BITS
    placed: dict[int, tuple[list[int], list[int]]] = {}
    for size, n, to in pack(sizes, shards):
        starts, where = placed.setdefault(size, ([0], []))
        where.append(to)
        starts.append(starts[-1] + n)
    runs = spark.createDataFrame([(s, sum_[-1], sum_[:-1], to) for s, (sum_, to) in placed.items()], "gsize long, n long, starts array<long>, shards array<int>")
    ranked = _ranked(groups, "gsize", [F.col("g")], F.xxhash64("g"), runs.select("gsize", "n"), len(placed) <= BROADCAST_SIZES, "rank")
    of = ranked.join(runs.drop("n"), "gsize").select("g", F.element_at("shards", F.size(F.filter("starts", lambda s: s <= F.col("rank")))).alias("shard"))
    rows = materialize(base.join(of, "g"), "shard-of")
    per = rows.groupBy("shard").agg(F.count("*").alias("n"))
    out = _ranked(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("g")], F.xxhash64("doc_id", "text_crc32"), per, shards <= BROADCAST_SIZES, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
