"""Work that is done row by row by a function from outside: captures, retries, transforms.

Functions run in Arrow batches on executors. A row that fails gives a row with its error and
stops no other, so tasks can run again after a lost executor without harm."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatloom.operators.collate import file_group
from chatloom.operators.ledger import anti_resume
from chatloom.session import materialize


class Retry(Exception):
    """A failure that may pass: the row can be tried again."""


#: A row as a dictionary, and the number of the attempt from 0, to the result's columns.
Work = Callable[[dict, int], dict]


def capture(rows: DataFrame, work: Work, schema: str, attempt: int = 0) -> DataFrame:
    """``rows`` with the columns of ``schema`` that ``work`` returns for each, ``status`` (``ok`` or
    ``failed``), ``error`` and ``retryable``."""
    result = StructType.fromDDL(schema)
    names = result.fieldNames()
    kinds = rows.schema.fields + result.fields + StructType.fromDDL("status string, error string, retryable boolean").fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    found = work(row, attempt)
                    out.append([*(found[n] for n in names), "ok", None, False])
                except Exception as e:  # any failure is the row's own
                    out.append([*(None for _ in names), "failed", str(e), isinstance(e, Retry)])
            done = pd.DataFrame(out, columns=[*names, "status", "error", "retryable"], dtype=object)
            yield pd.concat([b.reset_index(drop=True), done], axis=1)

    return rows.mapInPandas(run, StructType(kinds))


def produce(rows: DataFrame, work: Work, schema: str, attempts: int, workers: int | None = None) -> DataFrame:
    """``capture`` with retryable failures tried again, ``attempts`` times at most; what still
    fails is dropped as ``failed``. Adds ``attempts``. ``workers`` bounds how many tasks run at
    once. Each attempt is written, so no row is worked on twice for another's sake."""
    columns, done, left = rows.columns, None, rows
    for attempt in range(attempts):
        tried = left.repartition(workers) if workers else left
        tried = materialize(capture(tried, work, schema, attempt).withColumn("attempts", F.lit(attempt + 1)), "attempt")
        again = F.col("retryable") & (attempt + 1 < attempts)
        done = tried.filter(~again) if done is None else done.unionByName(tried.filter(~again))
        left = tried.filter(again).select(columns)
        if left.isEmpty():
            break
    return done


def capture_offline(rows: DataFrame, key: str, out: str, work: Work, schema: str, keep: Column | None = None, per: int = 2000) -> DataFrame:
    """Capture the rows that ``keep`` takes and that ``out`` doesn't have yet, append the good ones
    there by groups of ``per`` keys, and return the failed ones. Running it again goes on where
    it stopped."""
    spark = rows.sparkSession
    kinds = StructType(rows.schema.fields + StructType.fromDDL(schema).fields)
    try:
        rows = anti_resume(rows, spark.read.schema(kinds).parquet(out), key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    done = materialize(capture(rows.filter(keep) if keep is not None else rows, work, schema), "captured")
    good = done.filter("status = 'ok'").select(kinds.fieldNames())
    good.withColumn("grp", file_group(F.col(key), per)).write.mode("append").partitionBy("grp").parquet(out)
    return done.filter("status <> 'ok'")


def per_sample(rows: DataFrame, transform: Callable[[dict], dict], schema: str) -> DataFrame:
    """Each row through a function of dictionaries."""
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([transform(r) for r in b.to_dict("records")], columns=names)

    return rows.mapInPandas(run, schema)


def with_collate(rows: DataFrame, batch: str, collate: Callable[[list[dict]], dict], schema: str, order: str | None = None) -> DataFrame:
    """One row for each batch from a function of its rows (in ``order``). A batch fits in memory
    by its definition."""
    names = StructType.fromDDL(schema).fieldNames()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order) if order else group
        return pd.DataFrame([collate(group.to_dict("records"))], columns=names)

    return rows.groupBy(batch).applyInPandas(run, schema)


class Loader:
    """Batches of rows in order, the next partition being fetched while one is worked on. What was
    handed out and not finished when it closes can be tried again."""

    def __init__(self, rows: DataFrame, order: str, size: int):
        self.rows, self.size = rows.repartitionByRange(order).sortWithinPartitions(order), size
        self.open: list[list] = []
        self.finished = 0

    def __iter__(self) -> Iterator[list]:
        batch: list = []
        for row in self.rows.toLocalIterator(prefetchPartitions=True):
            batch.append(row)
            if len(batch) == self.size:
                self.open.append(batch)
                yield batch
                batch = []
        if batch:
            self.open.append(batch)
            yield batch

    def done(self, batch: list) -> None:
        self.open.remove(batch)
        self.finished += 1

    def close(self, terminal: Callable[[list], bool] = lambda batch: False) -> tuple[list[list], list[list]]:
        """The unfinished batches: those that are lost for good, and those to try again."""
        lost = [b for b in self.open if terminal(b)]
        return lost, [b for b in self.open if b not in lost]
