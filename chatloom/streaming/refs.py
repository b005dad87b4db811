"""Reference streams: an append-only log read to its end, deduplicated, dealt in complete count
windows, and acknowledged durably.

Each micro-batch is written under its id, so a batch that runs again after a failure replaces
what it wrote: effects are exactly once. Rows that do not fill a window stay in the pending
table until later rows do, or the log ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.session import shared_dir


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; ``files_per_trigger`` bounds a batch, which is
    the running form of back pressure."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``each(batch, batch_id)`` over all that the log holds, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """The first row of each key, as a table: the state store holds the keys seen."""
    query = stream.dropDuplicates(keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


class Dispatcher:
    """Deals references to ranks in complete windows of ranks * per_rank, in the order of
    ``order``. Ids in the ledger or dealt before are skipped and counted."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, ranks: int, per_rank: int, key: str = "sample_id", order: str = "seq"):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.ranks, self.size, self.key, self.order = ranks, ranks * per_rank, key, order
        self.kinds = f"{schema}, window bigint, rank int"

    def _table(self, name: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("ignoreMissingFiles", True)
        try:
            return reader.parquet(f"{self.folder}/{name}/*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def dispatched(self) -> DataFrame:
        return self._table("dispatched", self.kinds)

    def pending(self, batch: int) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/pending/batch={batch}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def pump(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: the rows left by the batch before, then the new ones."""
        earlier = self.dispatched().filter(F.col("window") >= 0).withColumn("__b", F.element_at(F.split(F.col("_metadata.file_path"), "batch="), -1)) if batch_id else None
        known = earlier.filter(F.split("__b", "/")[0].cast("int") < batch_id).select(self.key, "window") if earlier is not None else self.spark.createDataFrame([], f"{self.key} string, window bigint")
        done = known.agg(F.coalesce(F.max("window") + 1, F.lit(0)).alias("w")).first()["w"]
        rows = self.pending(batch_id - 1).unionByName(batch.select(self.pending(batch_id - 1).columns))
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(self.key).orderBy(self.order))).filter("__r = 1").drop("__r").join(known.select(self.key), self.key, "left_anti")
        rows = rows.withColumn("__p", F.row_number().over(Window.orderBy(self.order)) - 1).persist()  # one batch, bounded by files_per_trigger
        whole = rows.count() // self.size * self.size
        dealt = rows.filter(F.col("__p") < whole).withColumns({"window": F.floor(F.col("__p") / self.size) + done, "rank": F.pmod(F.pmod(F.col("__p"), F.lit(self.size)), F.lit(self.ranks)).cast("int")})
        dealt.drop("__p").write.mode("overwrite").parquet(f"{self.folder}/dispatched/batch={batch_id}")
        rows.filter(F.col("__p") >= whole).drop("__p").write.mode("overwrite").parquet(f"{self.folder}/pending/batch={batch_id}")
        rows.unpersist()
        self.last = batch_id

    def run(self, stream: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Drain the stream: the rows dealt, and the tail that is dropped at the end."""
        self.last = -1
        drain(stream, self.pump, f"{self.folder}/checkpoint")
        return self.dispatched(), self.pending(self.last)


def acknowledge(batch: DataFrame, batch_id: int, folder: str, key: str = "sample_id") -> None:
    """Record acknowledged ids and the batch's marker; running it again changes nothing."""
    batch.select(key).distinct().write.mode("overwrite").parquet(f"{folder}/acked/batch={batch_id}")


def publish(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Publish a batch of references whole or not at all; publishing it again replaces it. Works as
    ``foreachBatch`` too."""
    batch.write.mode("overwrite").parquet(f"{folder}/published/batch={batch_id}")


def published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All references that are published, with the ``batch`` of each: how far a publisher that
    failed had come."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/published")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
