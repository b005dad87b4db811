"""URL filter: a cascade of Bloom filters that is exact over the corpus's own keys.

A URL is judged by its lookup keys: every host suffix at a label boundary joined with every
path prefix whose length some rule has. The *universe* is the set of all lookup keys of the
corpus. Level 1 encodes the listed keys, level 2 the universe keys that level 1 passes
wrongly, level 3 the listed keys that level 2 passes, and so on until a level makes no
mistake over the universe. Membership of any key of the corpus is then exact, and judging a
URL needs neither a join nor a shuffle: the levels are literals in the projection. Lists whose
levels would be too large for that are cut by ranges of a hash, each with a cascade and a
projection of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the levels that travel as literals at once; longer lists are judged in ranges.
MAX_FILTER_BYTES = 16 << 20
#: More levels than any set needs: each halves what is left, but for chance.
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def lookup_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys ``host suffix + path prefix``, longest first; ties: the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.substring(path, 1, n) for n in lengths]), lambda p: F.lit(True))
    prefixes = F.array_distinct(F.filter(F.zip_with(prefixes, F.array(*map(F.lit, lengths)), lambda p, n: F.when(F.length(p) == n, p)), lambda p: p.isNotNull()))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((-F.length(s) - F.length(p)).alias("n"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")))))
    keys = F.transform(F.array_sort(keys), lambda k: k["key"])
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: list[int]

    def passes(self, key: Column) -> Column:
        table = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        found = None
        for at in positions(key, self.number, self.bits, self.hashes):
            bit = F.getbit(F.get(table, (at / 64).cast("int")), (at % 64).cast("int")) == 1
            found = bit if found is None else found & bit
        return found


def positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions by double hashing, seeded with the level's number: it is hashed before the
    key, so keys that meet in one level need not meet in another."""
    one = F.pmod(F.xxhash64(F.lit(number), key), F.lit(bits).cast("long"))
    two = F.pmod(F.xxhash64(F.lit(number), F.lit(1), key), F.lit(bits - 1).cast("long")) + 1
    return [F.pmod(one + i * two, F.lit(bits).cast("long")) for i in range(hashes)]


def shape(n: int, others: int) -> tuple[int, int]:
    """Bits and hash functions: the fewer listed keys among the others, the sharper."""
    wrong = min(0.5, max(1e-4, n / (others + 1)))
    hashes = max(1, round(-math.log2(wrong)))
    return 64 * math.ceil(max(1.0, 1.45 * hashes * n) / 64), hashes


def encode(keys: DataFrame, number: int, bits: int, hashes: int) -> Level:
    """One level over the column ``key``; what comes to the driver is at most ``bits`` bits."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, bits, hashes))).alias("at"))
    rows = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["set"]
    return Level(number, bits, hashes, words)


def build_cascade(listed: DataFrame, others: DataFrame, seed: int = 0) -> list[Level]:
    """Levels over distinct ``key``s, listed ones and all others of the universe."""
    inside, outside = materialize(listed, "keys"), materialize(others, "keys")
    n, left = inside.count(), outside.count()
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"{n} keys can't be told apart by {MAX_LEVELS} levels")
        level = encode(inside, seed + len(levels), *shape(n, left))
        levels.append(level)
        wrong = materialize(outside.filter(level.passes(F.col("key"))), "keys")
        discard(outside)
        inside, outside = wrong, inside
        left, n = n, wrong.count()
    discard(inside, outside)
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Exact for every key of the universe: the first level that refuses the key decides."""
    inside = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        inside = F.when(levels[i].passes(key), inside).otherwise(F.lit(i % 2 == 1))
    return inside


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``rule`` (host and path prefix, such as ``example.com/en/``) and ``verdict``
    (``allow`` or ``block``). A rule fits its host and all subdomains if the path starts with
    the rule's; the longest wins; a URL without a rule gets ``default``. Rules with a null
    part are no rules; of equal rules with both verdicts, block holds. A null URL or one
    without ``://`` has an empty host and path and gets ``default``. Repeated rows each get
    their row; an empty table gives an empty result; columns named as the added ones are
    replaced. Levels beyond ``max_bytes`` are built and used one range of keys after another,
    each in a pass over the pages that keeps the longest hit so far.
    """
    rules = rules.filter(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).groupBy(F.col("rule").alias("key")).agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("key", F.concat(F.translate(F.regexp_extract("key", r"(?s)^[^/]*", 0), UPPER, LOWER), F.regexp_extract("key", r"(?s)^[^/]*(.*)", 1)))
    rules = materialize(rules.groupBy("key").agg(F.max("verdict").alias("verdict")), "url-rules")
    lengths = sorted(r[0] for r in rules.select((F.length("key") - F.length(F.regexp_extract("key", r"(?s)^[^/]*", 0))).alias("n")).distinct().collect())
    added = ("host", "path", "rule", "verdict")
    named = pages.drop(*added, HIT).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not lengths:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = lookup_keys(F.col("host"), F.col("path"), lengths)
    universe = named.select(F.explode(keys).alias("key")).distinct()
    universe = materialize(universe.join(rules.select("key", "verdict"), "key", "left"), "url-keys")
    whole = universe.count()
    size = sum(2 * shape(r["count"], whole)[0] // 8 for r in rules.groupBy("verdict").count().collect())  # a few verdicts; later levels are smaller than the first
    ranges = max(1, math.ceil(size / max_bytes))
    for i in range(ranges):
        cascades = {}
        for n, verdict in enumerate(("block", "allow")):
            part = universe if ranges == 1 else universe.filter(_range_of(F.col("key"), ranges) == i)
            same = F.coalesce(F.col("verdict") == verdict, F.lit(False))
            cascades[verdict] = build_cascade(part.filter(same).select("key"), part.filter(~same).select("key"), 1000 * n)

        def judged(k: Column, cascades=cascades, i=i) -> Column:
            out = F.when(member(k, cascades["block"]), F.lit("block")).when(member(k, cascades["allow"]), F.lit("allow"))
            return out if ranges == 1 else F.when(_range_of(k, ranges) == i, out)

        hit = F.get(F.filter(F.transform(keys, lambda k: F.struct(k.alias("rule"), judged(k).alias("verdict"))), lambda h: h["verdict"].isNotNull()), F.lit(0))
        if i:  # of hits of two ranges the longer; no two keys of a URL are of one length, host and path
            at = lambda h: F.array_position(keys, h["rule"])
            hit = F.when(F.col(HIT).isNull() | (at(hit) < at(F.col(HIT))), F.coalesce(hit, F.col(HIT))).otherwise(F.col(HIT))
        before, named = named, named.withColumn(HIT, hit)
        if ranges > 1:
            named = materialize(named, "url-hits")
            discard(before)
    return named.withColumns({"rule": F.col(f"{HIT}.rule"), "verdict": F.coalesce(F.col(f"{HIT}.verdict"), F.lit(default))}).drop(HIT)


HIT = "__url_hit"


def _range_of(key: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(ranges))
