"""Readers of conversation files. Paths are anything that Spark reads."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import strip
from chatloom.operators.order import in_file_order, ordered
from chatloom.schemas import CONVERSATION, SAMPLE_REF
from chatloom.session import local_path

SUFFIXES = (".json", ".jsonl")


def read_json(spark: SparkSession, path: str, schema: str | None = CONVERSATION) -> DataFrame:
    """A JSON or JSONL file by its suffix; any other is an error."""
    if not path.endswith(SUFFIXES):
        raise ValueError(f"{path}: expected one of {', '.join(SUFFIXES)}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", path.endswith(".json")).json(path)


def numbered_lines(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """``line, value`` in the order of files and places in them, numbered from ``start``; no line
    is moved."""
    return in_file_order(spark.read.text(path).select("value"), "line", start).select("line", "value")


def blank_line(c: Column) -> Column:
    return F.length(strip(c)) == 0


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with their 1-based ``line``; a line that is no JSON object fails the query with its
    number. Blank lines are skipped."""
    lines = numbered_lines(spark, path, 1).filter(~blank_line(F.col("value")))
    good = F.try_parse_json("value").isNotNull() & F.startswith(strip(F.col("value")), F.lit("{"))
    lines = lines.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line"), F.lit(": expected a JSON object")))))
    return lines.select("line", F.from_json("value", schema).alias("row")).select("line", "row.*")


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with their 0-based ``source_row_index`` (blank lines count but give no row) and an
    ``error`` where the line is no JSON object."""
    lines = numbered_lines(spark, path, 0).filter(~blank_line(F.col("value")))
    good = F.coalesce(F.try_parse_json("value").isNotNull() & F.startswith(strip(F.col("value")), F.lit("{")), F.lit(False))
    return lines.select(F.col("line").alias("source_row_index"), F.from_json(F.when(good, F.col("value")), schema).alias("row"), F.when(~good, "Expected a JSON object").alias("error"), "value").select("source_row_index", "row.*", "error", F.when(~good, F.col("value")).alias("data"))


def detect_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON array or JSONL, told by the first character that isn't blank."""
    first = spark.read.text(path).filter(~blank_line(F.col("value"))).limit(1).collect()
    if first and first[0]["value"].lstrip().startswith("["):
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return strict_jsonl(spark, path, schema).drop("line")


def safe_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``conversations`` (objects as JSON texts of their values), ``tools`` and ``text``; lines
    that are no object or whose conversations are no list give no row, messages that are no
    object are left out."""
    lines = spark.read.text(path).select("value").filter(F.try_parse_json("value").isNotNull())
    listed = F.get_json_object("value", "$.conversations")
    items = F.from_json(F.when(F.startswith(listed, F.lit("[")), listed), "array<string>")
    kept = F.transform(F.filter(items, lambda x: F.startswith(strip(x), F.lit("{"))), lambda x: F.from_json(x, "map<string,string>"))
    out = lines.select(kept.alias("conversations"), F.get_json_object("value", "$.tools").alias("tools"), F.get_json_object("value", "$.text").alias("text"))
    return out.filter("conversations IS NOT NULL OR text IS NOT NULL")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, length`` of all files below, in order, none opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "length").orderBy("path")


def manifest(files: DataFrame, run_id: str, limit: int | None = None) -> DataFrame:
    """One metadata row per file: ``sample_id`` is ``run:%08d`` of its place in path order."""
    files = files.orderBy("path").limit(limit) if limit is not None else files
    numbered = ordered(files.select(F.col("path").alias("uri")), "uri", name="at")
    return numbered.select(F.format_string("%s:%08d", F.lit(run_id), "at").alias("sample_id"), F.lit(run_id).alias("run_id"), "uri", F.lit(1).alias("schema_version"))


def load_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feature rows of Parquet files, or of JSON lines plain or compressed (``.gz``), by suffix."""
    if path.endswith((".json", ".jsonl", ".gz")):
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).parquet(path)


#: Paths, and bytes of files, after which a piece is handed on.
MANY, PIECE = 10_000, 8 << 20


def _hidden(name: str) -> bool:
    """As Spark's readers see it."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the files in each folder, and below if ``deep``."""
    def fail(e: OSError) -> None:
        raise e

    held: list[str] = []
    for b in batches:
        for folder, deep in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for at, folders, names in os.walk(folder, onerror=fail, followlinks=True):
                folders[:] = [x for x in folders if deep and not _hidden(x)]
                held += [f"{at}/{x}" for x in names if not _hidden(x)]
                while len(held) >= MANY:
                    yield pa.RecordBatch.from_pydict({"path": held[:MANY]})
                    held = held[MANY:]
    yield pa.RecordBatch.from_pydict({"path": pa.array(held, pa.string())})


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths as Spark writes them and the files' bytes, null where there is no reading them."""
    paths, values, n = [], [], 0
    piece = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], names=["path", "value"])
    for b in batches:
        for path in b.column(0).to_pylist():
            try:
                with pa.input_stream(path, compression="detect") as f:
                    values.append(f.read())
            except OSError:
                values.append(None)
            paths.append("file:" + re.sub(r'[\x00-\x20\x7f"#%<>?\[\\\]^`{|}]', lambda m: f"%{ord(m[0]):02X}", path))
            n += len(values[-1] or b"")
            if n >= PIECE or len(paths) >= MANY:
                yield piece()
                paths, values, n = [], [], 0
    yield piece()


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of all files below. In a mounted file system executors list and open them:
    Spark's reader lists them on the driver, opens a few in each task, and takes milliseconds for
    each through Hadoop's local file system. Compressed ones are told by their suffix. In other
    stores the reader is Spark's, which has no row for empty files."""
    root = local_path(spark, path)
    if root is None or not os.path.isdir(root):
        return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    with os.scandir(root) as found:
        folders = [(f"{root.rstrip('/')}/{x.name}", True) for x in found if x.is_dir() and not _hidden(x.name)]
    listed = spark.createDataFrame([(root.rstrip("/") or "/", False), *folders], "folder string, deep boolean").mapInArrow(_list, "path string")
    tasks = 4 * spark.sparkContext.defaultParallelism  # by bytes of paths, which are few, it would be one or two
    return listed.repartition(tasks, "path").mapInArrow(_fetch, "path string, value binary").withColumn("value", F.col("value").cast("string"))


def fetch_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file below: ``path``, its fields, and an ``error`` where it can't be
    read as that; no other sample takes its place."""
    files = whole_files(spark, path)
    good = F.coalesce(F.try_parse_json("value").isNotNull() & F.startswith(strip(F.col("value")), F.lit("{")), F.lit(False))
    return files.select("path", F.from_json(F.when(good, F.col("value")), schema).alias("row"), F.when(~good, "not a feature file").alias("error")).select("path", "row.*", "error")


def concat_jsonl(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of several JSONL files or folders as one."""
    wrong = [p for p in paths if not p.rstrip("/").endswith(".jsonl")]
    if wrong:
        raise ValueError(f"expected .jsonl: {', '.join(wrong)}")
    return spark.read.schema(schema).json(paths)


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_REF).json(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Benchmark corpora: (question, answer) columns of each, and how a label is found in the answer.
CORPORA: dict[str, tuple[str, str]] = {
    "gsm8k": ("question", "answer"), "math500": ("problem", "answer"), "aime": ("Question", "Answer"), "mmlu": ("question", "answer"),
    "gpqa": ("Question", "Correct Answer"), "ceval": ("question", "answer"), "mmstar": ("question", "answer"), "humaneval": ("prompt", "test"),
    "mbpp": ("text", "test_list"), "mtbench": ("prompt", "category"), "simpleqa": ("problem", "answer"), "livecodebench": ("question_content", "platform"),
    "financeqa": ("question", "answer"),
}


def benchmark_rows(name: str, rows: DataFrame, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """``question, label`` of a benchmark corpus; columns may be missing."""
    q, a = CORPORA[name]
    pick = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(pick(q).alias("question"), (label(pick(a)) if label else pick(a)).alias("label"))
