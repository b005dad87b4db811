"""Writers. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import redact
from chatloom.operators.collate import file_group
from chatloom.session import local_path


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, other scripts' characters as they are. ``mode`` ``ignore`` writes once."""
    rows.write.mode(mode).json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Nothing is computed if the output is there."""
    write_jsonl(rows, path, "ignore")


def distinct_paths(*paths: str) -> None:
    if len(set(paths)) != len(paths):
        raise ValueError("inputs and outputs must be different paths")


def write_routed(rows: DataFrame, path: str, status: str = "status") -> None:
    """Success, error and skipped rows in folders of their own, in one pass."""
    rows.write.mode("errorifexists").partitionBy(status).json(path)


def write_splits(rows: DataFrame, train: str, test: str, split: str = "split") -> None:
    distinct_paths(train, test)
    for name, path in (("train", train), ("test", test)):
        write_jsonl(rows.filter(F.col(split) == name).drop(split), path)


def write_features(rows: DataFrame, path: str, index: Column, per: int = 2000, codec: str = "zstd") -> None:
    """Feature rows by groups of ``per`` rows of their source."""
    rows.withColumn("grp", file_group(index, per)).write.mode("errorifexists").option("compression", codec).partitionBy("grp").parquet(path)


#: Folders that ``write_each`` deals its files to.
FOLDERS = 1024


def write_each(rows: DataFrame, path: str, key: str, body: str) -> None:
    """A file for each row, named by ``key=value``, with the text of ``body``, in folders by a hash of
    the key. Hadoop's local file system starts processes for each file that it makes, so files in a
    mounted one are Python's."""
    named = rows.select(F.pmod(F.hash(key), F.lit(FOLDERS)).alias("folder"), key, F.col(body).alias("value"))
    root = local_path(rows.sparkSession, path)
    if root is None:
        named.write.partitionBy("folder", key).option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, made = uuid.uuid4().hex, set()
        for b in batches:
            for folder, k, value, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = f"{root}/folder={folder}"
                if folder not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(folder)
                with open(f"{at}/.{mine}", "w", encoding="utf-8") as f:
                    f.write(value or "")
                os.replace(f.name, f"{at}/{key}={quote(str(k), safe='')}.{row}")  # whole also if two attempts meet
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    os.makedirs(root, exist_ok=True)
    named.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def without_nan(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose arrays hold no NaN."""
    for c in columns:
        rows = rows.filter(~F.exists(c, lambda x: F.isnan(x)))
    return rows


def loggable(rows: DataFrame) -> DataFrame:
    """Columns that hold no secret, by their names."""
    return rows.select(*[F.col(f"`{c}`") for c in redact(rows.columns)])


def publish_mapping(mapping: DataFrame, size: int, path: str) -> None:
    """Write a vocabulary mapping once, whole; another number of rows is an error."""
    n = mapping.count()
    if n != size:
        raise ValueError(f"the mapping has {n} rows, not {size}")
    mapping.write.mode("ignore").parquet(path)


def digests(files: DataFrame) -> DataFrame:
    """sha256 of each file (``path, content``), to compare two stores."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose digests differ or that only one store has."""
    both = a.withColumnRenamed("sha256", "a").join(b.withColumnRenamed("sha256", "b"), "path", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", "a", "b")


def write_results(results: DataFrame, path: str, key: str = "benchmark") -> None:
    """Benchmark results as JSON, a folder for each benchmark; those there are replaced, others
    stay."""
    old = results.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode")
    results.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        results.write.mode("overwrite").partitionBy(key).json(path)
    finally:
        results.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", old)
