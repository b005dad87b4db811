"""Token files: ids of whole documents in ascending doc_id order, entropy-coded.

A file has a header, an index of documents (doc_id, tokens), checkpoints (one per block: first
token, place and number of its words, checksum of its ids), the blocks' states and words, and
a checksum of all that. All files share one frequency table. Any block decodes on its own from
its checkpoint. Files lie as rows of a Parquet dataset in the shared folder, so that they can
be written to and read from whatever store Spark reaches and survive lost executors.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm import rans
from chatloom.session import discard, materialize

MAGIC = b"RANSTOK2"
HEAD = struct.Struct("<8sIIQQI")
#: A file ends with the document that fills it.
FILE_TOKENS = 16 * rans.BLOCK
#: Bytes of units and their ids that a worker remembers (some 1.5 million units), letters of the
#: longest that stay, and how many parts of units are at hand besides.
CACHE_BYTES, LONG, RECENT = 32 << 20, 256, 50_000
#: Bytes of text whose units are looked up together.
BATCH_BYTES = 8 << 20
#: Bits of a row's number within its range partition.
ROW_BITS = 33


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level tokenizers spell each byte: printable bytes of
    Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: ASCII punctuation that makes one piece with its like: all but apostrophes, which may begin a
#: contraction, and what special tokens are written with.
MARKS = r"""[!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*"""
#: A unit of letters with marks behind, or two such with a line's end between.
SIMPLE = re.compile(rf"([^\W\d_]+)({MARKS})(?:\n([^\W\d_]+)({MARKS}))?")
#: Letters above are left to the whole tokenizer.
LATIN = "ɐ"


class Encoder:
    """The tokenizer's ids, remembered by the units of text between spaces.

    The tokenizer (byte-level, without normalizer or prefix space) never joins what stands
    before a space to what follows it, unless white space meets there; such texts are
    encoded whole. Units of letters and marks go to the tokenizer's model piece by piece, as
    its own splitting would; all others through the whole tokenizer. Units are looked up by
    Arrow and their ids laid side by side by numpy, so that Python sees new units only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.apart = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.size = self.whole.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.line = self._piece("\n")
        self.recent: dict[str, bytes] = {}  # words and marks that units were put together from
        #: What is remembered: units, the ids of all in a row, how many each has, and whether white
        #: space stands at its left and right end (or it is empty).
        self.units = pa.array([], pa.string())
        self.ids, self.counts = np.empty(0, self.kind), np.empty(0, np.int64)
        self.left, self.right = np.empty(0, bool), np.empty(0, bool)

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece as the tokenizer's splitting gives it to its model."""
        if not piece.isascii() or piece == "\n":
            spelled = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        else:
            spelled = "Ġ" + piece[1:] if piece[0] == " " else piece
        return self._pack([t.id for t in self.model.tokenize(spelled)])

    def _part(self, piece: str) -> bytes:
        found = self.recent.get(piece)
        if found is None:
            found = self._piece(piece)
            if len(piece) <= LONG:
                self.recent[piece] = found
        return found

    def _whole(self, text: str) -> bytes:
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids)

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids of units, each with the space before it."""
        out, rest, piece, part = [], [], self._piece, self._part
        if len(self.recent) > RECENT:
            self.recent = {}
        for u in units:
            if u.isalpha() and (u.isascii() or max(u) < LATIN):
                out.append(piece(" " + u))
            elif u and (u.isascii() or max(u) < LATIN) and (m := SIMPLE.fullmatch(u)):
                word, marks, second, end = m.groups()
                known = part(" " + word)
                if marks:
                    known += part(marks)
                if second:
                    known += self.line + piece(second)
                    if end:
                        known += part(end)
                out.append(known)
            else:
                rest.append(len(out))
                out.append(b"")
        for i, e in zip(rest, self.whole.encode_batch_fast([" " + units[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = self._pack(e.ids)
        return out

    def _forget(self) -> None:
        """Beyond CACHE_BYTES, keep the units that were learned last, of half of them."""
        if self.ids.nbytes + self.units.nbytes > CACHE_BYTES:
            sizes = self.counts * self.kind.itemsize + pc.binary_length(self.units).to_numpy(zero_copy_only=False)
            keep = (np.cumsum(sizes[::-1])[::-1] <= CACHE_BYTES // 2) & (sizes <= LONG * 8)
            self.ids = self.ids[np.repeat(keep, self.counts)]
            self.counts, self.left, self.right = self.counts[keep], self.left[keep], self.right[keep]
            self.units = self.units.filter(pa.array(keep))

    def _remember(self, new: pa.Array) -> None:
        units = new.to_pylist()
        found = self._learn(units)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.kind)])
        self.counts = np.append(self.counts, np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize)
        self.left = np.append(self.left, np.fromiter((not u or u[0].isspace() for u in units), bool, len(units)))
        self.right = np.append(self.right, np.fromiter((not u or u[-1].isspace() for u in units), bool, len(units)))
        self.units = pa.concat_arrays([self.units, new])

    def _places(self, units: pa.Array) -> np.ndarray:
        """Where each unit stands among the remembered ones; new ones are learned."""
        self._forget()
        at = pc.index_in(units, value_set=self.units)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False)
        gaps = pc.is_null(at)
        missing, known = units.filter(gaps), len(self.units)
        new = missing.unique()
        self._remember(new)
        places = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
        places[gaps.to_numpy(zero_copy_only=False)] = known + pc.index_in(missing, value_set=new).to_numpy(zero_copy_only=False)
        return places

    def _head(self, head: str) -> bytes:
        """Ids of what stands before the first space of a text."""
        if not head or head.isalpha() and (head.isascii() or max(head) < LATIN):
            return self._piece(head) if head else b""
        return self._whole(head)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def encode_all(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """The ids of each text (none null) with ``tail`` behind, as bytes."""
        if not self.apart:
            return pa.array([(self._whole(t.as_py()) if t.as_py() else b"") + tail for t in texts], pa.large_binary())
        lists = pc.split_pattern(texts.cast(pa.string()), " ")
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes  # every text has a first unit, if an empty one
        is_unit = np.ones(len(flat), bool)
        is_unit[first] = False
        heads = flat.take(pa.array(first)).to_pylist()
        of = self._places(flat.filter(pa.array(is_unit)))
        own = [self._head(h) for h in heads]
        # White space on both sides of a space, or before one at the end of a text.
        begins, ends = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        begins[is_unit], ends[is_unit] = self.left[of], self.right[of]
        ends[first] = [h[-1:].isspace() for h in heads]
        meets = np.append(ends[:-1] & begins[1:] & is_unit[1:], False)
        last = first + sizes - 1
        meets[last] = ends[last] & is_unit[last]
        met = np.logical_or.reduceat(meets, first) if len(first) else meets
        for k in np.flatnonzero(met).tolist():
            own[k] = self._whole(texts[k].as_py())
        # The output in order: of each text the head, its units, the tail.
        store = np.concatenate([self.ids, np.frombuffer(b"".join([*own, tail]), self.kind)])
        counts = np.append(self.counts, [len(x) // self.kind.itemsize for x in (*own, tail)]).astype(np.int64)
        starts = np.cumsum(counts) - counts
        text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        item = np.full(len(text_of), len(counts) - 1, np.int32)
        is_tail = np.zeros(len(item), bool)
        is_tail[first + sizes + np.arange(len(sizes))] = True
        pieces = np.empty(len(flat), np.int32)
        pieces[is_unit], pieces[first] = of, len(self.counts) + np.arange(len(sizes))
        item[~is_tail] = pieces
        if met.any():
            keep = ~met[text_of] | (item >= len(self.counts))
            item, text_of = item[keep], text_of[keep]
        n = counts[item]
        upto = np.cumsum(n)
        at = np.repeat((starts[item] - (upto - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        out = store[at]
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(np.bincount(text_of, n, len(sizes)).astype(np.int64) * self.kind.itemsize, out=offsets[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some BATCH_BYTES of text together."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield at, upto
        at = upto


def _tokenize(path: str, end: int):
    """Batches of (doc_id, text, row) to (doc_id, row, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        tail = e._pack([end])
        for b in batches:
            for at, upto in _parts(b.column(1)):
                part = b.slice(at, upto - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), e.encode_all(part.column(1), tail).cast(pa.binary())], ["doc_id", "row", "ids"])

    return run


def _count(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                ids = np.frombuffer(b"".join(b.column(0).slice(at, 1024).to_pylist()), kind)
                total += np.bincount(ids, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    return run


#: A document in the index: its doc_id, whether that is null, its tokens.
INDEX = [("doc", "<i8"), ("null", "u1"), ("n", "<u8")]


def write_file(docs: list[tuple[int | None, np.ndarray]], table: rans.Table) -> bytes:
    """One file of documents (doc_id, ids), in this order."""
    ids = np.concatenate([d[1] for d in docs]).astype(np.int64) if docs else np.empty(0, np.int64)
    full, rest = divmod(len(ids), rans.BLOCK)
    parts = []
    if full:
        parts.append(rans.encode(ids[: full * rans.BLOCK].reshape(full, rans.BLOCK), table))
    if rest:
        parts.append(rans.encode(ids[full * rans.BLOCK :][None], table))
    blocks = full + bool(rest)
    counts = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.int64)
    raw = ids.astype("<u4")
    checks = np.zeros(blocks, [("first", "<u8"), ("word", "<u8"), ("words", "<u4"), ("tokens", "<u4"), ("crc", "<u4")])
    for i in range(blocks):
        part = raw[i * rans.BLOCK : (i + 1) * rans.BLOCK]
        checks[i] = (i * rans.BLOCK, int(counts[:i].sum()), counts[i], len(part), zlib.crc32(part.tobytes()))
    index = np.array([(d or 0, d is None, len(x)) for d, x in docs], INDEX)
    body = b"".join([HEAD.pack(MAGIC, rans.SCALE, blocks, len(ids), len(docs), rans.LANES), index.tobytes(), checks.tobytes(), *[p[0].astype("<u8").tobytes() for p in parts], *[p[1].astype("<u4").tobytes() for p in parts]])
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(blob: bytes, table: rans.Table, blocks: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The index (doc, null, n) and the ids; with ``blocks`` the ids of those blocks only. Raises
    ValueError where a checksum fails."""
    if len(blob) < HEAD.size + 4 or zlib.crc32(blob[:-4]) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("the file's checksum fails")
    magic, scale, n_blocks, tokens, docs, lanes = HEAD.unpack_from(blob)
    if (magic, scale, lanes) != (MAGIC, rans.SCALE, rans.LANES):
        raise ValueError("not a token file of this format")
    index = np.frombuffer(blob, INDEX, docs, HEAD.size)
    at = HEAD.size + index.nbytes
    checks = np.frombuffer(blob, [("first", "<u8"), ("word", "<u8"), ("words", "<u4"), ("tokens", "<u4"), ("crc", "<u4")], n_blocks, at)
    at += checks.nbytes
    states = np.frombuffer(blob, "<u8", n_blocks * lanes, at).reshape(n_blocks, lanes)
    words = np.frombuffer(blob, "<u4", (len(blob) - 4 - at - states.nbytes) // 4, at + states.nbytes)
    wanted = blocks if blocks is not None else range(n_blocks)
    out = []
    for size in sorted({int(checks["tokens"][i]) for i in wanted}, reverse=True):  # full blocks, then the last
        some = [i for i in wanted if checks["tokens"][i] == size]
        own = np.concatenate([words[int(checks["word"][i]) : int(checks["word"][i] + checks["words"][i])] for i in some])
        ids = rans.decode(states[some], own, checks["words"][some].astype(np.int64), size, table)
        for k, i in enumerate(some):
            if zlib.crc32(ids[k].astype("<u4").tobytes()) != checks["crc"][i]:
                raise ValueError(f"block {i}: its checksum fails")
        out.append(ids.reshape(-1))
    return index, np.concatenate(out) if out else np.empty(0, np.uint32)


def _write(kind: str, freq: bytes):
    """Batches of (doc_id, row, ids) to files. A file ends where it is full, and where a row
    isn't the next of the one before: rows of one range partition may be read in parts, and parts
    of several in any order, but a file never spans what lies between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(np.frombuffer(freq, np.int64))
        docs, held, last = [], 0, None

        def flush() -> pa.RecordBatch:
            row = [last - len(docs) + 1, last, held, write_file(docs, table)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES, strict=True)], NAMES)

        for b in batches:
            for d, row, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if docs and (row != last + 1 or held >= FILE_TOKENS):
                    yield flush()
                    docs, held = [], 0
                ids = np.frombuffer(x.as_py(), kind)
                docs.append((d, ids))
                last, held = row, held + len(ids)
        if docs:
            yield flush()

    return run


NAMES = ["first_row", "last_row", "tokens", "blob"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _read(freq: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(np.frombuffer(freq, np.int64))
        for b in batches:
            for first, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                index, ids = read_file(blob.as_py(), table)
                ends = np.cumsum(index["n"].astype(np.int64))
                starts = ends - index["n"].astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc = pa.array(index["doc"].astype(np.int64), mask=index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([first] * len(index), pa.int64()), doc, pa.array(starts), pa.array(index["n"].astype(np.int64)), pa.array(crcs, pa.int64())], ["first_row", "doc_id", "at", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` into token files; returns the files (one row each: ``first_row, last_row,
    tokens, blob``) and the shared frequency table (``id, freq``), both as written in the shared
    folder. Rows are numbered by range partition and place in it, so the files' rows are disjoint
    and ascend as the documents do.

    Texts (null ones as empty) are encoded by the tokenizer in the file ``tokenizer`` without
    special tokens, and each ends with the id ``end``. Rows go in ascending doc_id order, null
    ones last, those with the same doc_id by a hash of their text; each repeated row is
    written. An empty table gives no file; other columns are ignored. The frequencies are of
    all tokens."""
    spark = docs.sparkSession
    size = encoder(tokenizer).size
    kind = encoder(tokenizer).kind.str
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ids = rows.mapInArrow(_tokenize(tokenizer, end), "doc_id long, row long, ids binary")
    ids = materialize(ids, "token-ids")
    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(_count(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id at most
        counts[r["id"]] = r["n"]
    freq = rans.quantize(counts)
    table = materialize(spark.createDataFrame(list(enumerate(freq.tolist())), "id long, freq long"), "token-frequencies")
    files = materialize(ids.mapInArrow(_write(kind, freq.tobytes()), "first_row long, last_row long, tokens long, blob binary"), "token-files")
    discard(ids)
    return files, table


def read_tokens(files: DataFrame, table: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``, decoded and
    checked. ``start`` counts the tokens of all documents before. Files that overlap or leave
    rows of a range partition out are an error."""
    freq = np.array([r["freq"] for r in sorted(table.collect())], np.int64).tobytes()  # a row for each id
    meta = files.select("first_row", "last_row", "tokens", F.shiftright("first_row", ROW_BITS).alias("part"))
    sums = meta.groupBy("part").agg(F.sum("tokens").alias("held"))
    before = lambda name, at: F.coalesce(F.sum(name).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", before("held", Window.partitionBy(F.lit(0)).orderBy("part")).alias("base"))  # a row for each range partition
    at = Window.partitionBy("part").orderBy("first_row", "last_row")
    next_row = F.coalesce(F.lag("last_row").over(at) + 1, F.shiftleft("part", ROW_BITS))
    meta = meta.select("first_row", "part", before("tokens", at).alias("off"), next_row.alias("next")).join(sums, "part")
    off = F.when(F.col("first_row") == F.col("next"), F.col("off") + F.col("base")).otherwise(F.raise_error(F.lit("token files overlap or are missing")).cast("long"))
    docs = files.select("first_row", "blob").mapInArrow(_read(freq), "first_row long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(meta.select("first_row", off.alias("off")), "first_row").select("doc_id", (F.col("off") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
