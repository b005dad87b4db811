"""Following JSON lines that grow: a stream by byte offsets that takes complete lines only.

Spark's own file source sees new files, not growth. Here an offset is the number of bytes taken
of each file, always behind a line's end, so a line that is still being written is left for
later and a restart goes on where the checkpoint stands. Ranges of bytes are read by executors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "complete_lines"
#: Bytes of a file that one task reads, and that are looked at from the end for the last line's end.
PIECE, BLOCK = 32 << 20, 1 << 20


def _files(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _last_end(store, path: str, low: int, high: int) -> int:
    """The end of the last complete line of ``path`` between two offsets, ``low`` if there is none."""
    with store.open_input_file(path) as f:
        while high > low:
            at = max(low, high - BLOCK)
            f.seek(at)
            found = f.read(high - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            high = at
    return low


class Piece(InputPartition):
    def __init__(self, path: str, low: int, high: int, end: int):
        super().__init__(f"{path}:{low}-{high}")
        self.path, self.low, self.high, self.end = path, low, high, end


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        from pyarrow import fs

        store, root = _files(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return {f.path: _last_end(store, f.path, 0, f.size) for f in sorted(names, key=lambda f: f.path)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, high in end.items():
            low = start.get(path, 0)
            out += [Piece(path, at, min(at + PIECE, high), high) for at in range(low, high, PIECE)]
        return out

    def read(self, part: Piece) -> Iterator[tuple]:
        """Lines that begin in the piece; the line that a piece begins within is the one before's."""
        store, _ = _files(self.path)
        with store.open_input_file(part.path) as f:
            f.seek(max(0, part.low - 1))
            data = f.read(part.high - max(0, part.low - 1))
            while not data.endswith(b"\n") and (more := f.read(min(BLOCK, part.end - f.tell()))):
                stop = more.find(b"\n") + 1
                data += more[:stop] if stop else more
                if stop:
                    break
        at = part.low
        if part.low:  # the byte before tells whether a line begins here
            skip = data.find(b"\n") + 1
            at, data = part.low - 1 + skip, data[skip:] if skip else b""
        for line in data.split(b"\n")[:-1]:
            if at < part.high:
                yield (part.path, at, line.decode("utf-8", "replace"))
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class CompleteLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, offset bigint, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LineReader(self.options["path"])


def follow(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, value``: the complete lines of a file, or of the files of a folder, as a
    stream. The path is one that Arrow's file systems open."""
    spark.dataSource.register(CompleteLines)
    return spark.readStream.format(NAME).option("path", path).load()


def scan(path: str, offsets: dict[str, int] | None = None) -> tuple[dict[str, int], list[Piece]]:
    """What a reader that holds no stream asks for: the next offsets, and the ranges up to them."""
    reader = LineReader(path)
    end = reader.latestOffset()
    return end, reader.partitions(offsets or {}, end)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append what is there to the table ``out``, stop, and return the table."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


