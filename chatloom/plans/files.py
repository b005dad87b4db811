"""Queries through files: written in the shared folder from the driver tables, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.functions import text as X
from chatloom.operators import metrics, regenerate, templates, validate
from chatloom.plans.conversations import plain
from chatloom.plans.registry import query, table
from chatloom.sources import readers, sinks
from chatloom.streaming.refs import fresh_folder

MESSAGES = "conversations array<struct<role: string, content: string>>"


def line_files(rows: DataFrame, name: str) -> str:
    """Lines of files in the order of their column ``line``, as paths and places in them go."""
    folder = fresh_folder(rows.sparkSession, name)
    rows.repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(folder)
    return folder


@query("S02_K01_jsonl_round_trip", "SELECT conv_id::VARCHAR AS id, count(*) AS messages, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "jsonl")
    sinks.write_jsonl(plain(spark, sf_dir), folder + ".jsonl")
    out = readers.read_json(spark, folder + ".jsonl", f"id string, {MESSAGES}")
    return out.select("id", F.size("conversations").cast("bigint").alias("messages"), F.md5(F.array_join(F.transform("conversations", lambda m: m["content"]), "|").cast("binary")).alias("digest"))



@query("S05_E02_lenient_lines", "SELECT doc_id AS source_row_index, CASE WHEN doc_id % 4 <> 1 THEN doc_id::VARCHAR END AS id, CASE WHEN doc_id % 4 = 1 THEN 'Expected a JSON object' END AS error FROM documents WHERE doc_id % 4 <> 0")
def lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = line_files(d.select(F.col("doc_id").alias("line"), F.expr("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'oops' ELSE '{\"id\":\"' || doc_id || '\"}' END").alias("value")), "lines")
    return readers.lenient_jsonl(spark, path, "id string").select("source_row_index", "id", "error")


@query("S03_S04_strict_lines", "SELECT doc_id + 1 AS line, doc_id::VARCHAR AS id FROM documents")
def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = line_files(d.select(F.col("doc_id").alias("line"), F.expr("'{\"id\":\"' || doc_id || '\"}'").alias("value")), "lines")
    return readers.strict_jsonl(spark, path, "id string")


@query("S06_safe_scan", "SELECT doc_id % 3 AS kind, count(*) AS n, sum(CASE doc_id % 3 WHEN 0 THEN 1 ELSE 0 END)::BIGINT AS messages FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1")
def safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("""CASE doc_id % 3 WHEN 0 THEN '{"conversations":[{"role":"user","content":{"a":' || doc_id || '}},7]}' WHEN 1 THEN '{"conversations":"no list"}' ELSE '{"text":"t' || doc_id || '"}' END""")
    path = line_files(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), v.alias("value")), "safe")
    out = readers.safe_conversations(spark, path).withColumn("kind", F.when(F.col("text").isNotNull(), F.lit(2)).otherwise(0).cast("bigint"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("conversations")), F.lit(0)).cast("bigint").alias("messages"))


@query("S07_S08_S15_manifest", "SELECT 'run:' || lpad((row_number() OVER (ORDER BY lang) - 1)::VARCHAR, 8, '0') AS sample_id, lang FROM (SELECT DISTINCT lang FROM documents)")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "features")
    table(spark, sf_dir, "documents").select("lang", "doc_id").repartition(1, "lang").write.partitionBy("lang").parquet(folder)
    out = readers.manifest(readers.list_files(spark, folder, "*.parquet"), "run")
    return out.select("sample_id", F.regexp_extract("uri", r"lang=([^/]*)/", 1).alias("lang"))


@query("S13_R02_ref_manifest", "SELECT 'e' || event_id AS sample_id, value AS v, user_id AS num_tokens FROM events")
def ref_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "refs")
    e = table(spark, sf_dir, "events")
    sinks.write_jsonl(e.select(F.concat(F.lit("e"), "event_id").alias("sample_id"), F.col("user_id").cast("int").alias("num_tokens"), F.create_map(F.lit("v"), F.col("value").cast("string")).alias("metadata")), folder)
    return readers.read_refs(spark, folder).select("sample_id", F.col("metadata")["v"].cast("double").alias("v"), F.col("num_tokens").cast("bigint").alias("num_tokens"))


@query("K04_routed_sink", "SELECT CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'skipped' END AS status, count(*) AS n FROM documents GROUP BY 1")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "routed")
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'skipped' END").alias("status"))
    sinks.write_routed(d, folder)
    return spark.read.schema("doc_id bigint, status string").json(folder).groupBy("status").agg(F.count("*").alias("n"))


@query("S14_benchmark_rows", "SELECT item_id::VARCHAR AS label, text AS question FROM benchmark")
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.col("item_id").cast("string").alias("answer"))
    return readers.benchmark_rows("gsm8k", b)


def echo(messages: list[dict], server: int) -> tuple[str, str | None]:
    last = messages[-1]["content"]
    if len(last) % 5 == 0:
        raise ValueError("refused")
    return f"{len(messages)}:{len(last)}", None


@query(
    "P24_A05_F20_regenerate",
    """WITH u AS (SELECT conv_id, bool_or(role = 'user' AND length(text) % 5 = 0) AS bad, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id)
    SELECT count(*) FILTER (NOT bad) AS success, count(*) FILTER (bad) AS error, 0::BIGINT AS skipped, (count(*) FILTER (NOT bad)) / count(*) AS success_share FROM u""",
)
def regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain(spark, sf_dir)
    return regenerate.outcome_counts(regenerate.regenerate(rows, echo), rows.count())


@query("W15_round_robin", "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN ((sum(CASE WHEN o_custkey % 3 <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 1) % 4)::INT END AS server FROM orders")
def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return regenerate.round_robin(rows, 4, F.col("o_custkey") % 3 != 0, "o_orderkey").select("o_orderkey", "server")


@query("W16_running_and", "SELECT k, string_agg(CASE WHEN f IS NULL OR i < f THEN 1 ELSE 0 END, ',' ORDER BY i) AS alive FROM (SELECT *, min(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY k) AS f FROM (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, l_partkey % 4 <> 0 AS ok FROM lineitem)) GROUP BY k")
def running_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return x.select("k", F.array_join(A.prefix_alive(F.transform("s", lambda z: z["l_partkey"] % 4 != 0)), ",").alias("alive"))


@query("T06_ignored_tokens", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(source) + 11 ELSE length(source) + 11 END::BIGINT AS supervised FROM documents")
def ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("'<|im_start|>assistant\\n' || CASE WHEN doc_id % 2 = 0 THEN '<think>\\n\\n</think>\\n\\n' ELSE '' END || source || '<|im_end|>\\n'")
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))
    out = templates.label_texts(rows, "qwen3-instruct", key="doc_id")
    return out.select("doc_id", A.mask_count(F.col("loss_mask")).cast("bigint").alias("supervised"))


@query("T07_T08_T09_channel_labels", "SELECT doc_id, (length('<|channel|>final<|message|>') + length(source) + length('<|end|>'))::BIGINT AS supervised FROM documents")
def channel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("'<|start|>user<|message|>' || lang || '<|end|><|start|>assistant<|channel|>final<|message|>' || source || '<|end|><|start|>user<|message|>more<|end|>'")
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))
    out = templates.label_texts(rows, "gpt-oss", key="doc_id")
    return out.select("doc_id", A.mask_count(F.col("loss_mask")).cast("bigint").alias("supervised"))


@query("T12_math_answer", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN '-' || doc_id || '.5' END AS v FROM documents")
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr(r"CASE doc_id % 4 WHEN 0 THEN 'so \\boxed{ ' || source || ' } 9' WHEN 1 THEN 'Answer: 3 and the answer ' || doc_id WHEN 2 THEN 'one 7 two -' || doc_id || '.5' ELSE 'none' END")
    return table(spark, sf_dir, "documents").select("doc_id", X.math_answer(c).alias("v"))


@query("T13_contest_answer", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN '12' ELSE CASE WHEN doc_id <= 999 THEN doc_id::VARCHAR ELSE '5' END END AS v FROM documents")
def contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr(r"CASE doc_id % 3 WHEN 0 THEN '\\boxed{x_1 = ' || doc_id || '}' WHEN 1 THEN 'final answer: 12, not 13' ELSE 'use 5 then ' || doc_id || ' done' END")
    return table(spark, sf_dir, "documents").select("doc_id", X.contest_answer(c).alias("v"))


@query("T16_code_block", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x = ' || doc_id WHEN 1 THEN 'def f(a):' || chr(10) || '  return ' || doc_id ELSE source END AS v FROM documents")
def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Sure:\\n```python\\nx = ' || doc_id || '\\n```\\nbye' WHEN 1 THEN 'Here def f(a):\\n  return ' || doc_id || '\\n\\ndef g():\\n  pass' ELSE ' ' || source || ' ' END")
    return table(spark, sf_dir, "documents").select("doc_id", X.code_block(c).alias("v"))


@query("P23_model_names", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'org/' || source ELSE source END AS v FROM documents")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE WHEN doc_id % 2 = 0 THEN 'org/Serve-Draft-' || source ELSE 'serve-draft/' || source END")
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_model_name(c, "Serve-Draft").alias("v"))


@query("K09_T18_redacted", "SELECT doc_id, n_chars AS n_tok, to_json({doc_id: doc_id, n_tok: n_chars}) AS logged FROM documents")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sinks.loggable(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("api_key"), F.col("source").alias("Password"), F.col("n_chars").alias("n_tok")))
    return d.withColumn("logged", F.to_json(F.struct(*d.columns)))


@query("K11_T17_mirror_check", "SELECT path, a IS NULL AS missing_left, b IS NULL AS missing_right FROM (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 10 <> 1 THEN 1 END AS a, CASE WHEN doc_id % 10 <> 2 THEN 1 END AS b FROM documents) WHERE a IS NULL OR b IS NULL")
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    out = sinks.differing(sinks.digests(d.filter("doc_id % 10 <> 1")), sinks.digests(d.filter("doc_id % 10 <> 2")))
    return out.select("path", F.col("a").isNull().alias("missing_left"), F.col("b").isNull().alias("missing_right"))


@query(
    "M15_confidence_terms",
    """WITH x AS (SELECT l_orderkey % 10 AS g, l_discount * 8 + 0.1 AS c, CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS y, l_suppkey % 3 <> 0 AS v FROM lineitem)
    SELECT g, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS bce, round(avg(abs(c - y)), 6) AS abs_error, round(avg(CASE WHEN (c >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM x WHERE v GROUP BY g""",
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 <> 0").select((F.col("l_orderkey") % 10).alias("g"), (F.col("l_discount") * 8 + 0.1).cast("double").alias("c"), F.when(F.col("l_partkey") % 2 == 0, 1.0).otherwise(0.0).alias("y"))
    return x.groupBy("g").agg(*[F.round(t, 6).alias(n) for n, t in metrics.confidence_terms(F.col("c"), F.col("y")).items()])


@query("X01_X04_registered_validation", "SELECT conv_id::VARCHAR AS id, count(*) FILTER (role = 'assistant')::INT AS n FROM conversations GROUP BY conv_id")
def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatloom.operators import presets

    presets.PRESETS["identity-again"] = presets.identity
    return presets.prepare("identity-again", plain(spark, sf_dir)).select("id", validate.assistant_count(F.col("conversations")).alias("n"))
