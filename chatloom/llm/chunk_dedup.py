"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes: every byte's random 32-bit number is added to the hash
shifted left by two, so it depends on the last 16 bytes only. A chunk ends where the hash is
the least of all within REACH bytes on both sides. Ends depend on the bytes around them only,
so an insertion changes the chunks that it touches and no others, wherever it stands. Chunks
are deduplicated by a 128-bit digest: of equal chunks in several documents the first (by
doc_id and place) stays. Neighbouring repeated chunks make a passage; passages of at least
LEAST_BYTES are reported, short coincidences such as a common line are not.

Whole chunks cover a passage only in part, and short words leave few of them. So windows of
WORDS words are digested as well: of every SPREAD neighbouring windows the one whose gear hash
(at its ninth word, so of bytes within it) is the least. 50 words that stand in two documents
byte for byte hold SPREAD windows, hence one that is chosen in both. A repeated window is a
passage by itself, and joins the repeated chunks that it overlaps. A text of fewer words is
one window, which shows exact copies of short texts.

Hash and minima are taken by doublings over whole texts: with windows of k, those of 2k are
h[i] + (h[i-k] << 2k), and min(m[i], m[i-k]).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import discard, materialize

#: Bytes on each side within which an end's hash is the least: chunks of 41 bytes on average.
REACH = 20
#: A longer stretch without an end (equal bytes, say) is cut every MOST bytes.
MOST = 512
#: Bytes of repeated chunks that count as a passage. Of a passage, up to 56 bytes that ends
#: depend on and parts of two chunks are not seen, so windows of words are taken as well.
LEAST_BYTES = 96
#: Words of a window, and windows of which one is chosen: WORDS + SPREAD - 1 = 50 always suffice.
WORDS, SPREAD = 25, 26
#: The word of a window whose end gives its hash: nine words have 17 bytes or more, gear takes 16.
NINTH = 8
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
GEAR = np.array([random.Random(20 + i).getrandbits(32) for i in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        new = h.copy()
        new[k:] += h[:-k] << np.uint32(2 * k)
        h = new
    return h


def ends(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``, the last at its end. Of equal least hashes within reach
    the first counts."""
    n = len(data)
    if n <= 2 * REACH:
        return np.array([n] if n else [], np.int64)
    h = gear(np.frombuffer(data, np.uint8))
    width, m = 1, h
    while 2 * width <= REACH:
        m = np.minimum(m[width:], m[:-width])  # m[i]: the least of h[i : i + width]
        width *= 2
    m = np.minimum(m[: len(m) - (REACH - width)], m[REACH - width :])  # windows of REACH
    at = np.arange(REACH, n - REACH)
    last = at[(h[at] < m[at - REACH]) & (h[at] <= m[at + 1])] + 1
    last = np.append(last, n)
    gaps = np.diff(last, prepend=0)
    if gaps.max() > MOST:
        parts = [np.arange(e - g + MOST, e, MOST) for e, g in zip(last.tolist(), gaps.tolist(), strict=True) if g > MOST]
        last = np.sort(np.concatenate([last, *parts]))
    return last


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chosen windows of ``data``; words are runs of anything but ASCII
    white space. Of equal least hashes the first counts."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff((~SPACE[raw]).astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin) < WORDS:
        return begin[:1], end[-1:]
    h = gear(raw)[end[NINTH : len(end) - WORDS + 1 + NINTH] - 1]
    m = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    spread, width = min(SPREAD, len(m)), 1
    while 2 * width <= spread:
        m = np.minimum(m[width:], m[:-width])
        width *= 2
    if width < spread:
        m = np.minimum(m[: len(m) - (spread - width)], m[spread - width :])
    at = np.unique(m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return begin[at], end[at + WORDS - 1]


def digested(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Starts, ends and digests of the chosen windows. Overlapping neighbours with the same
    digest (a line repeated on and on) are one piece, which covers them all."""
    first, last = windows(data)
    digests = [xxhash.xxh3_128_digest(data[s:e], 1) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
    new = np.array([i == 0 or digests[i] != digests[i - 1] or first[i] > last[i - 1] for i in range(len(digests))], bool)
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:], len(new))[: len(at)] - 1], [digests[i] for i in at.tolist()]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            digests, docs, starts, sizes, words = [], [], [], [], []
            for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if d is None or not data:
                    continue
                upto = ends(data)
                begin = np.concatenate(([0], upto[:-1]))
                digests += [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(begin.tolist(), upto.tolist(), strict=True)]
                first, last, found = digested(data)
                digests += found
                docs.append(np.full(len(upto) + len(first), d, np.int64))
                starts += [begin, first]
                sizes += [upto - begin, last - first]
                words += [np.zeros(len(upto), bool), np.ones(len(first), bool)]
            if docs:
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.concatenate(docs)), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(words))], ["hi", "lo", "doc_id", "start", "size", "words"])


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``hi, lo, doc_id, start, size, words``: every chunk and (``words``) every chosen window
    of every row, in bytes, with its digest."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces, "hi long, lo long, doc_id long, start long, size int, words boolean")


def _marked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Every piece that stands more than once, with the run of its document that it is in, what
    was counted of its digest, and whether this is its first place (``own``)."""
    every = pieces(docs, text, doc_id)
    # A digest counts as repeated by the hashes of its places; both sides of the join are plain
    # exchanges, so that a very common digest can be split.
    place = F.xxhash64("doc_id", "start")
    seen = every.groupBy("hi").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("hi")
    seen = materialize(seen, "repeated-digests")
    held = materialize(every.join(seen, "hi"), "repeated-chunks")
    discard(seen)
    if not docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter("count > 1").isEmpty():
        held = materialize(held.distinct(), "distinct-chunks")
    counts = held.groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min(F.struct("doc_id", "start")).alias("first"))
    counts = counts.filter("copies > 1").select("hi", "lo", "copies", "first", F.expr("a < b").alias("across"))
    counts = materialize(counts, "digest-counts")
    marked = held.join(counts, ["hi", "lo"])
    at = Window.partitionBy("doc_id").orderBy("start", "size", "hi", "lo", "words")
    before = F.max(F.col("start") + F.col("size")).over(at.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(at))
    return marked.withColumn("own", (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.start") == F.col("start")))


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_BYTES) -> DataFrame:
    """One row for each passage that stands elsewhere as well: ``doc_id, start_byte, end_byte,
    chunks, first_chunks, copies, across, first_doc_id``.

    A passage is a run of neighbouring or overlapping pieces (chunks, windows of words) that
    occur more than once, in other documents or at another place of the same, of ``least``
    bytes or more or with a window. Every passage of 50 words that stands elsewhere byte for
    byte is covered in part at least, and every exact copy of a text with words. ``chunks``
    counts the pieces, ``first_chunks`` those whose first occurrence (smallest doc_id, then
    place) this is; they stay when duplicates go, the others would be removed. ``copies`` is
    the largest number of places of one of its pieces, ``across`` tells whether one stands in
    another document too, ``first_doc_id`` is the smallest document that has one. Null and empty texts and null doc_ids
    have no chunks; rows with the same doc_id are one document, whose pieces at the same place
    and of the same digest count once; an empty table gives no rows; other columns are ignored.
    """
    runs = _marked(docs, text, doc_id).groupBy("doc_id", "run").agg(
        F.min("start").alias("start_byte"), F.max(F.col("start") + F.col("size")).alias("end_byte"), F.count("*").alias("chunks"), F.count_if("own").alias("first_chunks"),
        F.max("copies").alias("copies"), F.bool_or("across").alias("across"), F.min("first.doc_id").alias("first_doc_id"), F.bool_or("words").alias("words"),
    )
    return runs.filter((F.col("end_byte") - F.col("start_byte") >= least) | F.col("words")).drop("run", "words")


def _cut(at: int):
    """Batches of rows whose column ``at`` is the text and whose last two are the starts and ends
    of what goes, to the rows without those two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, starts, ends_ in zip(b.column(at), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                t = t.as_py()
                if t and starts:
                    data, kept, upto = t.encode("utf-8", "surrogatepass"), [], 0
                    for s, e in zip(starts, ends_, strict=True):
                        kept.append(data[upto:s])
                        upto = max(upto, e)
                    t = b"".join([*kept, data[upto:]]).decode("utf-8", "ignore")
                texts.append(t)
            columns = b.columns[:-2]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-2])

    return run


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_BYTES) -> DataFrame:
    """``docs`` whose texts have lost the passages that stand elsewhere before.

    Rows go by doc_id (null ones last), then by a hash of their text, and are taken one by one,
    so of equal rows the first keeps its text. Of a passage, the pieces go that don't have their
    first occurrence there; what a cut leaves of a character goes as well. Null texts stay
    null, a text that goes as a whole is empty; an empty table gives no rows."""
    order = [F.col(doc_id).asc_nulls_last(), F.xxhash64(text)]
    row, begin, end = "__chunk_row", "__chunk_starts", "__chunk_ends"
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns, F.monotonically_increasing_id().alias(row))
    rows = materialize(rows, "numbered-texts")
    piece = F.when(~F.col("own"), F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    runs = _marked(rows, text, row).groupBy("doc_id", "run").agg(F.collect_list(piece).alias("cut"), F.bool_or("words").alias("words"), (F.max(F.col("start") + F.col("size")) - F.min("start")).alias("bytes"))
    cuts = runs.filter((F.col("bytes") >= least) | F.col("words")).groupBy(F.col("doc_id").alias(row)).agg(F.array_sort(F.flatten(F.collect_list("cut"))).alias("cut"))
    cuts = cuts.select(row, F.col("cut.start").alias(begin), F.col("cut.end").alias(end))
    full = rows.join(materialize(cuts, "cuts"), row, "left").select(*docs.columns, begin, end)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return full.mapInArrow(_cut(docs.columns.index(text)), kinds)
