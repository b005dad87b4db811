"""Benchmark decontamination by spaced seeds.

A mask such as ``11011`` hashes the words under its ones and ignores those under its zeros, so
a window still matches when an ignored word was substituted. Windows of the benchmark under
several masks are joined with the windows of all documents; around each hit the two texts are
laid side by side and the equal words are counted.

The benchmark is a stated query set. A bitmap of its hashes goes along with the scan, so all
but the windows that may hit end in the scan's own stage. The benchmark's windows, each with
the few words around it, are counted and broadcast while they are few, else joined by a
shuffle on their hash. Texts are cut into stretches before their windows are taken, so that
very long ones cost time in proportion.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import materialize

#: Eight words, three of them ignored. Any substitution in a run of nine words leaves a window
#: of one of these untouched.
MASKS = ("11101001", "11011001", "10010111")
#: Words at each side of a hit that are compared as well.
MARGIN = 8
#: An overlap counts from this many equal words, or the share of a shorter item's words.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: Items of fewer words are no evidence of a leak, unless they are all of a document.
LEAST_ITEM = 5
#: Items of fewer words have seeds of their own: MASKS miss some overlaps that count, such as an
#: item of eight words without its first. From 11 to 13 words they miss none.
SHORT_ITEM = 11
#: Windows up to this number are broadcast: some 350 bytes each, as the words around a window
#: are at most those of the longest mask and MARGIN on both sides.
BROADCAST_WINDOWS = 200_000
#: Words of the bitmap at most (2 MB); a fuller one only lets more windows through to the join.
BITMAP_WORDS = 1 << 18
#: Windows of a stretch of text.
STRETCH = 64
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def enough(n: int) -> int:
    """Equal words that an item of ``n`` words needs."""
    return math.ceil(min(n, LEAST_WORDS) * LEAST_SHARE)


def short_seeds(n: int) -> list[tuple[str, int]]:
    """Masks, and where each lies, for an item of ``n`` words: the item falls in two parts more
    than words may differ, and each two parts are a seed, so one is left whole. Masks begin and
    end with 1, so words that a document's end cuts off are left out as well."""
    parts = n - enough(n) + 2
    out = []
    for two in combinations(range(parts), 2):
        bits = "".join("1" if i * parts // n in two else "0" for i in range(n))
        out.append((bits.strip("0"), bits.index("1")))
    return out


def _key(hashes: str, at: str, number: int, mask: str) -> str:
    """SQL for the hash of the window at ``at`` under a mask."""
    return f"xxhash64({number}, " + ", ".join(f"get({hashes}, {at} + {i})" for i, bit in enumerate(mask) if bit == "1") + ")"


def _places(rows: DataFrame, words: str, span: int) -> DataFrame:
    """Every place of every row's array ``words``: ``pos``, the array's size ``n``, and ``part``,
    the words around (from MARGIN before to ``span`` and MARGIN behind at least), whose first is
    at ``base``. Other columns stay."""
    others = [c for c in rows.columns if c != words]
    start = lambda s: F.greatest(s - MARGIN, F.lit(0))
    upto = lambda w, s: F.least(start(s) + (STRETCH + span + 2 * MARGIN), F.size(w)) - 1
    # Word by word, as slice() unpacks the whole array each time.
    part = lambda w, s: F.transform(F.sequence(start(s), upto(w, s)), lambda i: F.get(w, i))
    stretch = lambda w: lambda s: F.struct(F.size(w).alias("n"), s.alias("first"), start(s).alias("base"), part(w, s).alias("part"))
    # The words are bound once: Catalyst would put what makes them in each place that names them.
    parts = F.transform(F.array(F.col(words)), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(STRETCH)), stretch(w))))
    rows = rows.select(*others, F.explode(F.get(parts, F.lit(0))).alias("x")).select(*others, "x.n", "x.first", "x.base", "x.part")
    return rows.select(*others, "n", "base", "part", F.explode(F.expr(f"sequence(first, least(first + {STRETCH}, n) - 1)")).alias("pos"))


def _keys(masks: list[str]) -> list[Column]:
    """Each mask's hash at a place, null where the mask doesn't fit."""
    return [F.expr(f"CASE WHEN pos + {len(m)} <= n THEN {_key('part', 'pos - base', k, m)} END") for k, m in enumerate(masks)]


def _windows(items: DataFrame, masks: list[str], places: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """Every window of every item under every mask that may seed it: ``key, item_id, item_words,
    at, span, around`` (words from MARGIN before). A mask of ``places`` seeds only items of the
    sizes and at the words listed there."""
    at = _places(items, "item", max(map(len, masks)))
    keys = at.select("item_id", "n", "pos", "base", "part", F.posexplode(F.array(*_keys(masks))).alias("mask", "key")).filter("key IS NOT NULL")
    for k, m in enumerate(masks):
        if m in places:
            keys = keys.filter(f"mask <> {k} OR (n, pos) IN ({', '.join(f'({n}, {i})' for n, i in places[m])})")
    keys = keys.withColumn("span", F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1))
    around = F.expr(f"slice(part, greatest(pos - {MARGIN}, 0) - base + 1, span + {2 * MARGIN})")
    return keys.select("key", "item_id", F.col("n").alias("item_words"), F.col("pos").alias("at"), "span", around.alias("around"))


def _bitmap(windows: DataFrame, count: int) -> tuple[Column, int]:
    """A literal of the windows' hashes, 16 bits or more each while that is below the bound, and
    its number of words."""
    words = min(BITMAP_WORDS, 1 << max(4, math.ceil(math.log2(count * 16 / 64))))
    rows = windows.groupBy(F.expr(f"cast(key & {words - 1} as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 40) & 63 as int)))").alias("set")).collect()  # a row for each word at most
    table = [0] * words
    for r in rows:
        table[r["word"]] = r["set"]
    return F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>"), words


RESULT = ["doc_id", "item_id", "doc_word", "matched_words", "compared_words", "item_words"]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", masks: tuple[str, ...] = MASKS, least_item: int = LEAST_ITEM, most_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document and benchmark item that overlap: ``doc_id, item_id,
    doc_word`` (0-based, where the item's first word would lie; below 0 if it is cut off),
    ``matched_words, compared_words, item_words`` at the best place.

    ``benchmark`` has ``item_id`` and ``text``. A hit counts if, of the item's words from
    MARGIN before to MARGIN behind the seed, at least LEAST_SHARE of min(LEAST_WORDS, the
    item's words) equal the document's at the same distance. Of equally good places the first
    is reported. Items of fewer than ``least_item`` words count where a document has the same
    words and no others. Case and everything but letters and digits is ignored. Null and empty
    texts hold no words and match nothing. Rows with the same doc_id are reported as one
    document (the best place of any); an empty table gives no rows; other columns are ignored.
    """
    shortest = min(map(len, masks))
    every = benchmark.select("item_id", word_hashes(F.col("text")).alias("item")).filter(F.size("item") > 0).dropDuplicates(["item_id", "item"])
    every = materialize(every, "items")
    items, short = every.filter(F.size("item") >= least_item), every.filter(F.size("item") < least_item)
    sizes = [r["n"] for r in items.filter(F.size("item") < max(SHORT_ITEM, shortest)).select(F.size("item").alias("n")).distinct().collect()]
    places: dict[str, list[tuple[int, int]]] = {}
    for n in sorted(sizes):
        for mask, at in short_seeds(n):
            if mask not in masks:
                places.setdefault(mask, []).append((n, at))
    masks_ = [*masks, *places]
    words = docs.select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("words"))
    windows = materialize(_windows(items, masks_, places), "windows")
    found = _hits(words, windows, masks_, windows.count(), most_windows)
    if few := short.count():  # whole documents against whole items
        whole = words.filter(F.size("words").between(1, least_item - 1))
        same = whole.join(F.broadcast(short) if few <= most_windows else short, F.col("words") == F.col("item"))
        n = F.size("item")
        found = found.unionByName(same.select("doc_id", "item_id", F.lit(0).alias("doc_word"), n.alias("matched_words"), n.alias("compared_words"), n.alias("item_words")))
    best = F.struct(F.col("matched_words"), (-F.col("doc_word")).alias("d"), F.col("compared_words"), F.col("item_words"))
    out = found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.d")).alias("doc_word"), "b.matched_words", "b.compared_words", "b.item_words")


def _hits(words: DataFrame, windows: DataFrame, masks: list[str], count: int, most: int) -> DataFrame:
    table, size = _bitmap(windows, max(1, count))
    at = _places(words, "words", max(map(len, masks)))
    # Key by key: a filter over the places would take each key twice, and Catalyst each again.
    at = at.select("doc_id", "n", "base", "part", "pos", F.explode(F.array(*_keys(masks))).alias("key"))
    at = at.filter(F.getbit(F.get(table, F.expr(f"cast(key & {size - 1} as int)")), F.expr("cast(shiftright(key, 40) & 63 as int)")) == 1)
    hit = at.join(F.broadcast(windows) if count <= most else windows, "key")
    hit = hit.withColumn("from", F.greatest(F.col("at") - MARGIN, F.lit(0), F.col("at") - F.col("pos")))
    hit = hit.withColumn("upto", F.least(F.col("at") + F.col("span") + MARGIN, F.col("item_words"), F.col("n") - F.col("pos") + F.col("at")))
    ours = F.expr("slice(part, pos - at + from - base + 1, upto - from)")
    theirs = F.expr(f"slice(around, from - greatest(at - {MARGIN}, 0) + 1, upto - from)")
    hit = hit.withColumn("matched_words", F.size(F.filter(F.zip_with(ours, theirs, lambda a, b: a == b), lambda same: same)))
    hit = hit.withColumns({"doc_word": F.col("pos") - F.col("at"), "compared_words": F.col("upto") - F.col("from")})
    least = F.ceil(F.least(F.col("item_words"), F.lit(LEAST_WORDS)) * LEAST_SHARE)
    return hit.filter(F.col("matched_words") >= least).select(RESULT)
