"""Streaming queries: each drains the event log and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.plans.registry import query, table
from chatloom.streaming import refs

REF = "sample_id string, seq bigint"


def log(spark: SparkSession, sf_dir: str, parts: int = 3) -> str:
    """Events as a log of files, in order of arrival by file."""
    folder = refs.fresh_folder(spark, "log")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.col("event_id").alias("seq"))
    edge = rows.agg(F.max("seq")).first()[0] or 0
    for p in range(parts):
        rows.filter((F.col("seq") > p * edge // parts if p else F.lit(True)) & (F.col("seq") <= (p + 1) * edge // parts)).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("R01_R05_R15_stream_dedup", "SELECT DISTINCT user_id::VARCHAR AS sample_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = refs.read_log(spark, log(spark, sf_dir), REF)
    out = refs.fresh_folder(spark, "dedup")
    return refs.deduplicated(stream, ["sample_id"], f"{out}/rows", f"{out}/checkpoint").select("sample_id")


@query(
    "R06_stream_windows",
    """WITH f AS (SELECT user_id, min(event_id) AS seq FROM events GROUP BY user_id), p AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS n FROM f)
    SELECT user_id::VARCHAR AS sample_id, pos // 9 AS "window", (pos % 9 % 3)::INT AS rank FROM p WHERE pos < n // 9 * 9""",
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = refs.Dispatcher(spark, refs.fresh_folder(spark, "dispatch"), REF, ranks=3, per_rank=3)
    dealt, _ = d.run(refs.read_log(spark, log(spark, sf_dir), REF, files_per_trigger=1))
    return dealt.select("sample_id", "window", "rank")


@query("R09_durable_ack", "SELECT DISTINCT user_id::VARCHAR AS sample_id FROM events WHERE event_id % 2 = 0")
def stream_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = refs.fresh_folder(spark, "ack")
    stream = refs.read_log(spark, log(spark, sf_dir), REF, files_per_trigger=1).filter("seq % 2 = 0")
    refs.drain(stream, lambda b, i: refs.acknowledge(b, i, folder), f"{folder}/checkpoint")
    return spark.read.schema("sample_id string").parquet(f"{folder}/acked/*").distinct()
