"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles, as 64-bit hashes. Its sketch has k parts; each
shingle falls in one part and flips one bit there, so two sketches differ in at most
|A xor B| bits and at most as many parts. A Jaccard similarity of t or more between sets of
a <= c shingles bounds that difference by d = floor((a + c) * (1 - t) / (1 + t)). By the
pigeonhole principle k >= d + 1 parts leave at least k - d parts equal, with the same shingles
in them. Among those the fullest is among the d + 1 fullest parts of either document (ties:
the lower part), so each document is filed under its d + 1 fullest parts only, and no pair is
lost. A part's bits are wide (2**64) and sparse; they are kept as the XOR of a random 64-bit
code for each bit that is set, which equal parts share and others share by accident once in
2**64. k is fixed within a size band, and a document is also filed in lower bands that hold
partners of its own.

Documents with the same words are one class from the start. Classes that share a filed part
are candidates. A coarse sketch of 512 bits bounds their difference from below and drops most
that aren't linked; the sets of the others are compared exactly. First each class is compared
with one other of its part; classes found linked are then one component, and in parts that
still hold several components those are compared with each other, in blocks of bounded size.
So a large group of near copies isn't expanded into all its pairs, and no link between
different components can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import discard, materialize

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A band's largest size is this many times its smallest.
BAND = 2.0
#: Parts beyond the least number, as a share: leaves poor parts out of the filed ones.
SPARE = 1.1
#: 64-bit words of the coarse sketch.
COARSE = 8
#: Classes of a block in which components of a part are compared.
BLOCK = 1024
#: Ids up to this number (32 MB) are broadcast to pick texts; more are joined by shuffles.
BROADCAST_IDS = 4_000_000

def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; with fewer words, of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = min(n, len(words))
    out = np.full(len(words) - m + 1, m, np.uint64)
    for i in range(m):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def largest_difference(a: int, c: int, num: int, den: int) -> int:
    """The largest |A xor B| of sets of a and c elements with Jaccard >= num / den."""
    return (a + c) * (den - num) // (den + num)


def band_of(n: int) -> int:
    """Bands start at 1, 2, 4, ...; band b holds sizes below its double."""
    return n.bit_length() - 1


def filed_parts(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys under which a set is filed: in its own band, and in each lower band whose
    sizes a partner may have."""
    n = len(h)
    out = []
    least = -(-n * num // den)  # a partner's size at least
    for band in range(band_of(max(1, least)), band_of(n) + 1):
        top = 2 * (1 << band) - 1
        parts = int(SPARE * largest_difference(top, top * den // num, num, den)) + 1
        partner = n * den // num if band == band_of(n) else top
        keep = min(parts, largest_difference(n, partner, num, den) + 1)
        part = (_mix(h + np.uint64(band + 1)) >> np.uint64(11)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part, codes = part[order].astype(np.int64), _mix(h[order] * np.uint64(0xA0761D6478BD642F))
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.zeros(parts, np.uint64)
        sums[part[starts]] = np.bitwise_xor.reduceat(codes, starts)
        counts = np.zeros(parts, np.int64)
        counts[part[starts]] = np.diff(np.append(starts, len(part)))
        best = np.argsort(-counts, kind="stable")[:keep]
        out.append(_mix(_mix(sums[best] + best.astype(np.uint64)) + np.uint64(band << 58)))
    return np.concatenate(out)


def _describe(n: int):
    """Batches of (rid, text) to (rid, n_shingles, words): a digest of the normalized words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests = [], []
            for t in b.column(1):
                t = t.as_py()
                sizes.append(len(shingles(t, n)))
                digests.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").translate(LOWER).split())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n_shingles", "words"])

    return run


def _file(n: int, num: int, den: int):
    """Batches of (id, text) to (key, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                h = shingles(t.as_py(), n)
                if len(h):
                    rows.append((filed_parts(h, num, den), i, len(h)))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list) -> pa.RecordBatch:
    counts = [len(r[0]) for r in rows]
    keys = np.concatenate([r[0] for r in rows]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), counts)), pa.array(np.repeat(np.array([r[2] for r in rows], np.int32), counts))], ["key", "id", "n"])


def _verify(n: int, num: int, den: int):
    """Batches of (a, b, text_a, text_b) to the (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i, (s, t) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if a[i] != last:
                    last, held = a[i], shingles(s.as_py(), n)
                other = shingles(t.as_py(), n)
                both = len(held) + len(other) - len(np.union1d(held, other))
                keep[i] = den * both >= num * (len(held) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root``: the smallest id that links (a, b) connect each node to.

    Every round takes the smallest root among a node's neighbours, hooks the node's old root to
    it as well, then jumps to the root's root. Hooked roots make whole trees merge, so rounds
    grow with the logarithm of a chain's length. Roots only fall, and the rounds end when none
    moves; roots of all nodes are written in each round, links stay."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    roots = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "roots")
    moved = 1
    while moved:
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = materialize(roots.join(near, "id").select("id", "root", F.least("root", "near").alias("to")), "near")
        hooks = step.filter("to < root").groupBy(F.col("root").alias("id")).agg(F.min("to").alias("hook"))
        hooked = materialize(step.join(hooks, "id", "left").select("id", "root", F.least("to", "hook").alias("to")), "hooked")
        discard(step, roots)
        step = hooked
        of = step.select(F.col("id").alias("to"), F.col("to").alias("jump"))
        new = materialize(step.join(of, "to").select("id", F.col("root").alias("old"), F.least("to", "jump").alias("root")), "roots")
        moved = new.filter("old <> root").limit(1).count()
        discard(step)
        roots = new
    return nodes.join(roots.select("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _sketch(n: int):
    """Batches of (id, text) to (id, n, s0..): the parity of each of 64 * COARSE bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 64 * COARSE
        for b in batches:
            if b.num_rows:
                sets = [shingles(t.as_py(), n) for t in b.column(1)]
                rows = [np.packbits(np.bincount((_mix(h) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 == 1) for h in sets]
                words = np.stack(rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int32()), *[pa.array(words[:, i].copy()) for i in range(COARSE)]], ["id", "n", *SKETCH])

    return run


SKETCH = [f"s{i}" for i in range(COARSE)]


def _may_link(num: int, den: int) -> Column:
    """Whether sizes and coarse sketches of a row and another (prefix c) allow a link."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(x).bitwiseXOR(F.col(f"c{x}"))) for x in SKETCH])
    return (F.least("n", "cn") * den >= F.greatest("n", "cn") * num) & (differ <= F.floor((F.col("n") + F.col("cn")) * (den - num) / (den + num)))


def link_classes(classes: DataFrame, n: int, num: int, den: int, known: DataFrame | None = None) -> DataFrame:
    """``id, root`` for classes ``id, text``; ``known`` has links (a, b) that hold anyhow."""
    raw = materialize(classes.mapInArrow(_file(n, num, den), "key long, id long, n int"), "all-filed")
    shared = materialize(raw.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared")
    filed = materialize(raw.join(shared, "key"), "filed")
    discard(raw, shared)
    nodes = classes.select("id").distinct()
    classes = materialize(pick(classes, filed.select("id").distinct()), "filed-texts")
    sketches = classes.mapInArrow(_sketch(n), "id long, n int, " + ", ".join(f"{x} long" for x in SKETCH))
    at = materialize(filed.join(sketches, ["id", "n"]), "sketched")
    discard(filed)
    names = ["id", "n", *SKETCH]
    other = [F.col(x).alias(f"c{x}") for x in names]

    center = materialize(at.groupBy("key").agg(F.min_by(F.struct(*other), "id").alias("x")).select("key", "x.*"), "centers")
    pairs = at.join(center, "key").filter((F.col("id") != F.col("cid")) & _may_link(num, den))
    links = _linked(pairs.select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b")).distinct(), classes, n, num, den)
    discard(center)
    if known is not None:
        links = links.unionByName(known)
    roots = materialize(components(nodes, links), "roots")

    at = at.join(roots, "id")
    several = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("lo < hi").select("key", "blocks")
    rest = at.join(several, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cell = lambda x, y: F.least(x, y) * F.col("blocks") + F.greatest(x, y)
    rest = rest.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("cell", cell(F.col("block"), F.col("o"))).drop("o")
    rest = materialize(rest, "several")
    facing = rest.select("key", "cell", F.col("root").alias("croot"), F.col("block").alias("cblock"), *other)
    pairs = rest.join(facing, ["key", "cell"]).filter((F.col("root") < F.col("croot")) & (cell(F.col("block"), F.col("cblock")) == F.col("cell")) & _may_link(num, den))
    more = _linked(pairs.select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b")).distinct(), classes, n, num, den)
    if more.isEmpty():
        return roots
    # Only roots move any more: links between them stand for those of their members.
    of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
    more = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    top = components(roots.select(F.col("root").alias("id")).distinct(), more).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return roots.join(materialize(top, "joined"), "root").select("id", F.col("top").alias("root"))


def pick(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose ``id`` is (or, by ``left_anti``, isn't) in ``ids``."""
    ids = materialize(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def _linked(pairs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    pairs = materialize(pairs, "pairs")
    left = classes.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = classes.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_verify(n, num, den), "a long, b long"), "linked")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, class_id``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A document's set is
    its distinct n-word shingles; with fewer words, all its words as one; without words or
    with a null text it is empty, links with nothing and is its own component. Two documents
    are linked when ``den * |A and B| >= num * |A or B|``; a component's id is the smallest
    doc_id that links reach. ``class_id`` is the smallest doc_id with the same words. Rows
    that repeat a doc_id each get a row and are one node, linked with whatever one of them is
    linked with. An empty table gives no rows; other columns are ignored. A null doc_id is
    an id of its own: it gets a row, links with nothing and has a null component.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(doc_id).isNotNull(), F.col(text)).alias("text"))
    described = materialize(rows.mapInArrow(_describe(n), "doc_id long, n_shingles long, words binary"), "described")
    worded = described.filter("n_shingles > 0")
    first = materialize(worded.groupBy("words").agg(F.min("doc_id").alias("class_id")), "first")
    copies = worded.select(F.col("doc_id").alias("id")).join(first.select(F.col("class_id").alias("id")), "id", "left_anti").distinct()
    classes = pick(rows.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text"), copies, "left_anti")
    # Texts under one doc_id hold their classes together.
    several = worded.groupBy(F.col("doc_id").alias("id")).agg(F.min("words").alias("lo"), F.max("words").alias("hi")).filter("lo < hi").select("id")
    several = materialize(several, "several-texts")
    known, repeated = None, several.count() > 0
    if repeated:
        held = pick(worded.select(F.col("doc_id").alias("id"), "words"), several).join(first, "words").select("id", F.col("class_id").alias("b")).distinct()
        known = held.join(held.groupBy("id").agg(F.min("b").alias("a")), "id").filter("a < b").select("a", "b").distinct()
        known = materialize(known, "held-together")
    roots = link_classes(classes, n, num, den, known)
    of = first.join(roots.select(F.col("id").alias("class_id"), "root"), "class_id")
    out = described.join(of, "words", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce(own, F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    if repeated:  # a row without words belongs to what the other rows of its doc_id do
        whole = materialize(out.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "of-ids")
        out = out.drop("component_id").join(whole, "doc_id", "left").select("doc_id", "n_shingles", "component_id", "class_id")
    return out
