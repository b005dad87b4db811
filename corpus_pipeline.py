"""The corpus pipeline: from raw documents to shards for training.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all
but the last return the columns of ``documents``. Between stages the rows are written as
Parquet in the shared folder and read again. Decisions come back to the texts as sets of
doc_ids, broadcast while their counted number is small, so texts aren't shuffled. Where a
doc_id is null or repeated, rows are numbered first and decided on one by one; only rows that
are equal in all columns are dropped as repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, mixing, ngram_join, quality, queries, sharding
from chatloom.session import discard, discard_since, materialize, written

#: Near duplicates: five words, a similarity of 0.8.
SHINGLE, NUM, DEN = 5, 80, 100
#: The mixture takes this share of the words that are left, each document once at most.
SHARE = 0.8
SHARDS = 40


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is (left_semi) or isn't (left_anti) in ``ids``."""
    return ngram_join.pick(docs.withColumnRenamed("doc_id", "id"), ids.toDF("id"), how).withColumnRenamed("id", "doc_id").select(docs.columns)


def _rows(docs: DataFrame, once: bool = False) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with a doc_id of its own for each row, and what gives rows their doc_id back.

    Unique ids stay. If one is repeated or null, all rows are numbered in the order of doc_id
    (null ones last) and text, after equal rows were dropped if ``once``."""
    if not docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return docs, lambda out: out
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = (docs.dropDuplicates() if once else docs).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    named = rows.withColumnsRenamed({"doc_id": "__id", "__row": "doc_id"})
    return named, lambda out: out.drop("doc_id").withColumnRenamed("__id", "doc_id").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (poor or toxic) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).filter("keep").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays; of equal rows one."""
    docs, named = _rows(docs, once=True)
    found = materialize(ngram_join.jaccard_components(docs, SHINGLE, NUM, DEN), "components")
    return named(_by_id(docs, found.filter("doc_id <> component_id").select("doc_id"), "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, named = _rows(docs)
    return named(_by_id(docs, decontaminate.find_leaks(docs, benchmark).select("doc_id").distinct(), "left_anti"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights take, whole, each once."""
    docs, named = _rows(docs)
    taken = mixing.mix(docs, SHARE, queries.MIX_WEIGHTS, F.expr(queries.DOMAIN_SQL), queries.MIX_SEED, max_epochs=1)
    return named(_by_id(docs, taken.select("doc_id").distinct(), "left_semi"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("sharding", shards),
]
#: The classifier and the join can't be stated in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage wrote besides its result is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = written()
        docs, last = materialize(stage(spark, docs, sf_dir), "stage"), docs
        discard_since(spark, before, docs)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
