"""Queries over work by functions from outside, queues, registries, and files that grow or fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.operators import collate, contracts, ledger, metrics, order, presets, registries, templates, tokenizers, validate, workers
from chatloom.plans.conversations import plain
from chatloom.plans.ordering import TOKENS, tokens
from chatloom.plans.registry import query, table
from chatloom.sources import readers, sinks
from chatloom.streaming import refs, tail
from chatloom.streaming.refs import fresh_folder

NAMES = ["camel", "codealpaca-20k", "gsm8k", "hendrycks_math", "magicoder-evol-instruct", "math_qa", "opc", "opencodeinstruct"]


@query("S01_catalog", f"SELECT unnest({NAMES}) AS name, count(*) AS rows, count(DISTINCT doc_id) AS ids, 0::BIGINT AS skipped FROM documents")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named datasets over documents that have every column that any of them reads."""
    d = table(spark, sf_dir, "documents")
    text = F.col("doc_id").cast("string")
    columns = ("question", "answer", "problem", "solution", "instruction", "output", "response", "message_1", "message_2", "input", "Problem", "options", "Rationale")
    parts = []
    for name in NAMES:
        used = [c for c in columns if (c != "Problem" and c != "problem") or (c == "Problem") == (name == "math_qa")]
        out = presets.prepare(name, d.select(*[F.concat(text, F.lit(f" {c}")).alias(c) for c in used]))
        parts.append(out.agg(F.count("*").alias("rows"), F.count_distinct("conversations").alias("ids"), F.sum("skipped").cast("bigint").alias("skipped")).select(F.lit(name).alias("name"), "rows", "ids", "skipped"))
    return readers.union_all(parts)


@query("S03_detected_records", "SELECT kind, doc_id::VARCHAR AS id FROM documents, (SELECT unnest(['array', 'lines']) AS kind)")
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as JSON lines, and as files that hold an array of a thousand each."""
    d = table(spark, sf_dir, "documents").select(F.struct(F.col("doc_id").cast("string").alias("id")).alias("r"), F.floor(F.col("doc_id") / 1000).alias("b"))
    lines, arrays = fresh_folder(spark, "lines"), fresh_folder(spark, "arrays")
    d.select(F.to_json("r")).write.text(lines)
    d.groupBy("b").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("b").text(arrays)
    parts = [readers.detect_records(spark, p, "id string").select(F.lit(k).alias("kind"), "id") for k, p in (("array", f"{arrays}/*"), ("lines", lines))]
    return readers.union_all(parts)


@query("S09_feature_load", "SELECT kind, vec_id, round(embedding[1], 5) AS first FROM embeddings, (SELECT unnest(['json', 'parquet']) AS kind)")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, folder = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), fresh_folder(spark, "features")
    e.write.parquet(f"{folder}/plain")
    e.write.option("compression", "gzip").json(f"{folder}/packed.jsonl")
    parts = [readers.load_features(spark, f"{folder}/{p}", "vec_id bigint, embedding array<float>").select(F.lit(k).alias("kind"), "vec_id", F.round(F.get("embedding", F.lit(0)), 5).alias("first")) for k, p in (("json", "packed.jsonl"), ("parquet", "plain"))]
    return readers.union_all(parts)


@query("S10_fetch_errors", "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN url END AS url, CASE WHEN page_id % 4 = 0 THEN 'not a feature file' END AS error FROM pages")
def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page, every fourth broken: that row has an error, the others their own."""
    p, folder = table(spark, sf_dir, "pages").select("page_id", "url"), fresh_folder(spark, "fetched")
    body = F.when(F.col("page_id") % 4 == 0, F.lit('{"url": ')).otherwise(F.to_json(F.struct("url")))
    sinks.write_each(p.select("page_id", body.alias("value")), folder, "page_id", "value")
    out = readers.fetch_features(spark, folder, "url string")
    return out.select(F.regexp_extract("path", r"page_id=(\d+)[./]", 1).cast("bigint").alias("page_id"), "url", "error")


@query("S11_S12_tail", "SELECT event_id, user_id FROM events")
def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log followed by byte offsets in two goes, the second after it has grown."""
    e, folder = table(spark, sf_dir, "events").select("event_id", "user_id"), fresh_folder(spark, "tail")
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").json(f"{folder}/log")
        out = tail.drain(tail.follow(spark, f"{folder}/log"), f"{folder}/rows", f"{folder}/checkpoint")
    return out.select(F.from_json("value", "event_id bigint, user_id bigint").alias("r")).select("r.*")


@query("K02_K03_K10_write_once", "SELECT n_nationkey, n_name, true AS refused FROM nation")
def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is published first stays; a plain write refuses to replace it; equal paths are refused."""
    n, folder = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), fresh_folder(spark, "once")
    sinks.publish_mapping(n, n.count(), f"{folder}/map")
    sinks.publish_mapping(n.withColumn("n_name", F.lit("other")), n.count(), f"{folder}/map")
    sinks.write_once(n, f"{folder}/rows")
    sinks.write_once(n.limit(0), f"{folder}/rows")
    refused = 0
    for act in (lambda: sinks.write_jsonl(n, f"{folder}/rows"), lambda: sinks.write_splits(n, f"{folder}/a", f"{folder}/a"), lambda: sinks.publish_mapping(n, -1, f"{folder}/b")):
        try:
            act()
        except Exception:
            refused += 1
    rows = spark.read.schema("n_nationkey int, n_name string").json(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/map").join(rows.select("n_nationkey"), "n_nationkey").withColumn("refused", F.lit(refused == 3))


@query("K07_published_refs", "SELECT event_id % 3 AS batch, user_id::VARCHAR AS sample_id, count(*) AS n FROM events GROUP BY ALL")
def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the second published twice as after a failure."""
    e, folder = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"), "event_id"), fresh_folder(spark, "published")
    for batch in (0, 1, 1, 2):
        refs.publish(e.filter(F.col("event_id") % 3 == batch).select("sample_id"), batch, folder)
    return refs.published(spark, folder, "sample_id string").groupBy(F.col("batch").cast("bigint").alias("batch"), "sample_id").agg(F.count("*").alias("n"))


@query("K08_result_json", "SELECT source AS benchmark, count(*) AS questions, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents GROUP BY source")
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, folder = table(spark, sf_dir, "documents"), fresh_folder(spark, "results")
    sinks.write_results(d.groupBy(F.col("source").alias("benchmark")).agg(F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(0.0)), 6).alias("accuracy")), folder)
    return spark.read.schema("benchmark string, questions bigint, accuracy double").json(folder)


@query("F07_nonempty_rows", "SELECT conv_id::VARCHAR AS id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0")
def nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain(spark, sf_dir).withColumn("conversations", F.filter("conversations", lambda m: m["role"] == "assistant"))
    return rows.filter(validate.nonempty(F.col("conversations"))).select("id")


@query(
    "F11_option_errors",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'max_length must be positive' WHEN o_orderkey % 5 = 0 THEN 'min_loss_tokens must not be negative'
       WHEN o_orderkey % 3 = 0 THEN 'max_prompts must not be negative' WHEN o_orderkey % 2 = 0 THEN 'cache_dir and cache_key go together' END AS error FROM orders""",
)
def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, (k % 7).alias("max_length"), F.when(k % 5 == 0, -1).otherwise(0).alias("min_loss_tokens"), F.when(k % 3 == 0, -1).when(k % 3 == 1, 1).alias("max_prompts"), F.lit("dir").alias("cache_dir"), F.when(k % 2 == 1, "key").alias("cache_key"))
    return rows.select("o_orderkey", contracts.option_error().alias("error"))


@query("F12_no_tensors", "SELECT 'embeddings' AS name, 'embedding' AS path")
def no_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(name, path) for name in ("documents", "embeddings", "events", "orders") for path in contracts.tensor_columns(table(spark, sf_dir, name).schema)]
    return spark.createDataFrame(found, "name string, path string")


@query(
    "F22_handshake",
    """SELECT n_nationkey, concat_ws(',', CASE WHEN n_nationkey % 2 = 0 THEN 'prompt_seed' END, CASE WHEN n_nationkey % 3 = 0 THEN 'batch_size' END, CASE WHEN n_nationkey % 5 = 0 THEN 'total_steps' END) AS differ FROM nation""",
)
def handshake(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    fields = ["version", "prompt_epochs", "prompt_seed", "dp_size", "batch_size", "accumulation_steps"]
    ours = F.struct(F.lit(1).alias("version"), F.lit(3).alias("prompt_epochs"), k.alias("prompt_seed"), F.lit(8).alias("dp_size"), F.when(k % 3 != 0, 4).alias("batch_size"), F.lit(2).alias("accumulation_steps"))
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(3).alias("prompt_epochs"), F.when(k % 2 != 0, k).otherwise(-1).alias("prompt_seed"), F.lit(8).alias("dp_size"), F.lit(4).alias("batch_size"), F.lit(2).alias("accumulation_steps"), (k % 5).alias("total_steps")))
    theirs = F.from_json(body, ", ".join(f"{f} int" for f in [*fields, "total_steps"]))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(contracts.handshake(ours, theirs, fields), ",").alias("differ"))


@query("A09_token_weight", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars + 1.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM documents")
def token_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    denoms = F.when(k == 0, F.array(F.col("n_chars").cast("double"), F.lit(1.0)))
    mask = F.when(k == 1, F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    return table(spark, sf_dir, "documents").select("doc_id", metrics.token_weight(denoms, mask).cast("double").alias("weight"))


@query("U02_concat_jsonl", "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0")
def concatenated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, folder = table(spark, sf_dir, "documents").select("doc_id", "lang"), fresh_folder(spark, "concat")
    sinks.write_jsonl(d, f"{folder}/a.jsonl")
    sinks.write_jsonl(d.filter("doc_id % 2 = 0"), f"{folder}/b.jsonl")
    return readers.concat_jsonl(spark, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"], "doc_id bigint, lang string")


@query("E06_block_sample", "SELECT doc_id, least(n, 64) AS n, least(n, 64) - least(n, 64) // 3 AS supervised FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents) WHERE n >= 2")
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collate.normalize_block_sample(tokens(spark, sf_dir).filter(F.size("input_ids") >= 2), 64)
    return rows.select("doc_id", F.size("input_ids").cast("bigint").alias("n"), A.mask_count(F.col("loss_mask")).cast("bigint").alias("supervised"))


@query("E09_flatten_lists", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source || ',' || lang ELSE source END AS flat FROM documents")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda *x: F.array(*x)
    nested = F.when(F.col("doc_id") % 2 == 0, one(one(one(F.col("lang")), one(F.col("source"))), one(one(F.col("lang"))))).otherwise(one(F.lit(None).cast("array<array<string>>"), one(one(F.col("source")))))
    return collate.flatten_lists(table(spark, sf_dir, "documents").select("doc_id", nested.alias("x")), "x").select("doc_id", F.array_join("x", ",").alias("flat"))


@query("T10_tokenizer_labels", "SELECT doc_id, source || '<|im_end|>' || chr(10) AS taught FROM documents")
def tokenizer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels over the places of a real tokenizer's tokens, decoded again."""
    import public_tokenizers

    tokenize = tokenizers.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    t = F.expr("'<|im_start|>user\\n' || lang || '<|im_end|>\\n<|im_start|>assistant\\n' || source || '<|im_end|>\\n'")
    out = templates.label_texts(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), "qwen", key="doc_id", tokenize=tokenize)
    taught = lambda r: {"doc_id": r["doc_id"], "taught": tokenize.text([i for i, m in zip(r["input_ids"], r["loss_mask"], strict=True) if m])}
    return workers.per_sample(out.select("doc_id", "input_ids", "loss_mask"), taught, "doc_id bigint, taught string")


@query("M08_mapped_accuracy", "SELECT l_orderkey % 10 AS g, (count(*) FILTER (l_linenumber * 3 = l_linenumber + l_partkey % 7 AND l_suppkey % 3 <> 0))::DOUBLE AS correct, (count(*) FILTER (l_suppkey % 3 <> 0))::DOUBLE AS denom, round((count(*) FILTER (l_linenumber * 3 = l_linenumber + l_partkey % 7 AND l_suppkey % 3 <> 0)) / (count(*) FILTER (l_suppkey % 3 <> 0)), 9) AS accuracy FROM lineitem GROUP BY 1")
def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("g"), "l_linenumber", (F.col("l_linenumber") + F.col("l_partkey") % 7).alias("target"), F.when(F.col("l_suppkey") % 3 != 0, 1).otherwise(0).alias("mask"))
    out = metrics.mapped_accuracy(rows, "l_linenumber", [2 * i for i in range(16)], "target", "mask", ["g"])
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "R03_lease_queue",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 2 THEN 1 ELSE -1 END AS d FROM events),
    s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM e),
    z AS (SELECT user_id, max_by(s, event_id) - least(0, min(s)) AS depth FROM s GROUP BY user_id),
    p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM e WHERE d = 1)
    SELECT p.user_id AS queue, event_id AS sample_id, CASE WHEN r <= depth THEN 'pending' ELSE 'leased' END AS state, CASE WHEN r <= depth THEN depth - r END::BIGINT AS place FROM p JOIN z ON p.user_id = z.user_id""",
)
def lease_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three events put themselves into their user's queue, the third leases the first."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("sample_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 2, "get").otherwise("put").alias("event"), F.lit(1).alias("count"))
    return ledger.lease_queue(e)


@query("R13_captured_rows", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN length(source) END::BIGINT AS chars, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'refused ' || doc_id END AS error FROM documents")
def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(row: dict, attempt: int) -> dict:
        if row["doc_id"] % 5 == 0:
            raise ValueError(f"refused {row['doc_id']}")
        return {"chars": len(row["source"])}

    return workers.capture(table(spark, sf_dir, "documents").select("doc_id", "source"), work, "chars bigint").select("doc_id", "chars", "status", "error")


@query("R14_produced_rows", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS status, least(doc_id % 4 + 1, 3)::INT AS attempts FROM documents")
def produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(row: dict, attempt: int) -> dict:
        if attempt < row["doc_id"] % 4:
            raise workers.Retry("busy")
        return {"done": True}

    return workers.produce(table(spark, sf_dir, "documents").select("doc_id"), work, "done boolean", attempts=3, workers=4).select("doc_id", "status", "attempts")


@query("R17_offline_capture", f"WITH {TOKENS}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (i % 3 <> 2) AS sup FROM tok GROUP BY doc_id) SELECT doc_id, n AS hidden FROM s WHERE sup >= 10 AND doc_id % 6 <> 5")
def offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over part of the rows, and one over all that goes on where it stopped."""

    def work(row: dict, attempt: int) -> dict:
        if row["doc_id"] % 6 == 5:
            raise ValueError("no capture")
        return {"hidden": len(row["input_ids"])}

    rows, folder = tokens(spark, sf_dir).select("doc_id", "input_ids", "loss_mask"), fresh_folder(spark, "offline")
    enough = A.mask_count(F.col("loss_mask")) >= 10
    for part in (rows.filter("doc_id % 3 = 0"), rows):
        workers.capture_offline(part, "doc_id", folder, work, "hidden bigint", enough)
    return spark.read.schema("doc_id bigint, hidden bigint").parquet(folder).select("doc_id", "hidden")


@query("X02_mask_predicate", f"WITH {TOKENS} SELECT doc_id FROM tok GROUP BY doc_id HAVING count(*) FILTER (i % 3 <> 2) % 2 = 1")
def predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.accepted(tokens(spark, sf_dir), lambda mask: sum(mask) % 2 == 1).select("doc_id")


@query("X03_transform_collate", "SELECT doc_id // 16 AS batch, count(*) AS n, sum(length(source))::BIGINT AS chars, string_agg(lang, ',' ORDER BY doc_id) AS langs FROM documents GROUP BY 1")
def collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = workers.per_sample(d, lambda r: {"batch": r["doc_id"] // 16, "doc_id": r["doc_id"], "lang": r["lang"], "chars": len(r["source"])}, "batch bigint, doc_id bigint, lang string, chars bigint")
    together = lambda b: {"batch": b[0]["batch"], "n": len(b), "chars": sum(r["chars"] for r in b), "langs": ",".join(r["lang"] for r in b)}
    return workers.with_collate(rows, "batch", together, "batch bigint, n bigint, chars bigint, langs string", order="doc_id")


@query("X05_scored", "SELECT 'exact' AS benchmark, round(avg(CASE WHEN doc_id % 7 = doc_id % 5 THEN 1.0 ELSE 0.0 END), 6) AS score FROM documents")
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorers: registries.Registry = registries.Registry("benchmark")

    @scorers.add("exact")
    def exact(rows: DataFrame) -> DataFrame:
        return rows.agg(F.round(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)), 6).alias("score"))

    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("pred"), (F.col("doc_id") % 5).alias("label"))
    return readers.union_all([scorers.get(name)(rows).select(F.lit(name).alias("benchmark"), "score") for name in scorers.names()])


@query("X06_X07_X08_registered_parts", "SELECT doc_id, least(n, 16) AS n, '{\"text\":\"' || lang || '\"}' AS body FROM (SELECT doc_id, lang, len(string_split(text, ' ')) AS n FROM documents)")
def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows normalized for an algorithm, and requests by an adapter, both found by their names."""
    if "cut" not in registries.ALGORITHMS.parts:
        registries.DRAFTS.add("small", {"layers": 1})
        registries.ALGORITHMS.add("cut", registries.Algorithm(("input_ids", "loss_mask"), collate.normalize_sample, "small"))
        registries.ADAPTERS.add("text", lambda c: F.to_json(F.struct(c.alias("text"))))
    rows = tokens(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = registries.prepared("cut", rows, 16)
    return out.select("doc_id", F.size("input_ids").cast("bigint").alias("n"), registries.ADAPTERS.get("text")(F.col("lang")).alias("body"))
