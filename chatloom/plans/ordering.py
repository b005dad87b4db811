"""Queries over order, splits, shards, batches, windows and vocabulary counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.operators import collate, order, vocab
from chatloom.plans.registry import query, table

SEED, RANKS, BATCH = 42, 8, 32


def keyed(sql_key: str, seed: int = SEED) -> str:
    return f"md5('{seed}:' || {sql_key})"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey")


def in_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = orders(spark, sf_dir)
    r = rows.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    return order.in_key_order(rows, "o_orderkey", r["lo"] or 0, r["hi"] or 0), r["n"]


PLACED = "placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


@query("W04_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {keyed('o_orderkey')}, o_orderkey) - 1 AS pos FROM orders")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.shuffled(orders(spark, sf_dir), SEED, "o_orderkey")


@query("W05_split", f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {keyed('o_orderkey')}, o_orderkey) - 1 < ceil(0.05 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM orders")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.split(orders(spark, sf_dir), SEED, "o_orderkey")


@query("W06_epoch_permutation", " UNION ALL ".join(f"SELECT {e} AS epoch, o_orderkey, row_number() OVER (ORDER BY {keyed('o_orderkey', SEED + e)}, o_orderkey) - 1 AS pos FROM orders" for e in range(2)))
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [order.shuffled(orders(spark, sf_dir), SEED + e, "o_orderkey").withColumn("epoch", F.lit(e)) for e in range(2)]
    return rows[0].unionByName(rows[1])


@query(
    "W07_dp_shards",
    f"""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY {keyed('o_orderkey')}, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
    a AS (SELECT o_orderkey, pos FROM s UNION ALL SELECT o_orderkey, pos + n FROM s WHERE pos + n < ceil(n / 7.0) * 7)
    SELECT o_orderkey, pos, (pos % 7)::INT AS rank FROM a""",
)
def dp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sharded(orders(spark, sf_dir), SEED, "o_orderkey", 7)


@query("W08_contiguous_split", f"WITH {PLACED} SELECT o_orderkey, (ntile(7) OVER (ORDER BY pos) - 1)::INT AS rank FROM placed")
def contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = in_order(spark, sf_dir)
    return order.contiguous(rows, n, 7).drop("pos")


@query("W09_batch_slices", f"WITH {PLACED} SELECT o_orderkey, pos // {BATCH} AS batch, (pos % {BATCH} // {BATCH // RANKS})::INT AS rank FROM placed")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.batch_slices(in_order(spark, sf_dir)[0], BATCH, RANKS).drop("pos")


@query("W11_batches", f"WITH {PLACED} SELECT o_orderkey, pos // 31 AS batch FROM placed WHERE pos // 31 BETWEEN 2 AND n // 31 - 1")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = in_order(spark, sf_dir)
    return order.batches(rows, 31, n, drop_last=True, skip=2).drop("pos")


@query("W10_W12_count_windows", f"WITH {PLACED} SELECT o_orderkey, pos // 33 AS \"window\", (pos % 33 % 3)::INT AS rank, CASE WHEN pos < n // 33 * 33 THEN 'dispatched' ELSE 'dropped' END AS state FROM placed")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = in_order(spark, sf_dir)
    return order.windows(rows, 3, 11, n).drop("pos")


@query("W13_schedule", "SELECT (count(*) // 32 * 3 // 4)::BIGINT AS steps, (count(*) * 3 // (8 * 4 * 2))::BIGINT AS online_steps FROM orders")
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = orders(spark, sf_dir).count()
    return spark.createDataFrame([(order.total_steps(n, 32, 3, 4), order.online_steps(n, 3, 8, 4, 2))], "steps bigint, online_steps bigint")


@query("W02_accepted_cap", "SELECT doc_id FROM documents WHERE n_chars > 500 ORDER BY doc_id LIMIT 50")
def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.accepted_cap(table(spark, sf_dir, "documents"), 50, F.col("n_chars") > 500, "doc_id").select("doc_id")


@query("W01_W19_head_of_shuffle", f"SELECT doc_id FROM documents ORDER BY {keyed('doc_id')}, doc_id LIMIT 64")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.orderBy(order.seeded_key(SEED, F.col("doc_id")), "doc_id").limit(64).select("doc_id")


@query("W03_submitted_cap", "SELECT doc_id, ok FROM (SELECT doc_id, n_chars > 500 AS ok, sum(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) WHERE coalesce(before, 0) < 40")
def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("ok"))
    edge = d.filter("ok").orderBy("doc_id").limit(40).agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(edge)).filter("n < 40 OR doc_id <= last").select("doc_id", "ok")  # one row


@query("W14_E05_truncate_normalize", "SELECT doc_id, least(n, 64) AS n, least(n, 64) - least(n, 64) // 3 - CASE WHEN least(n, 64) % 3 = 0 THEN 0 ELSE 1 END AS supervised FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collate.normalize_sample(tokens(spark, sf_dir), 64)
    return rows.select("doc_id", F.size("input_ids").cast("bigint").alias("n"), A.mask_count(F.col("loss_mask")).cast("bigint").alias("supervised"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids (words' lengths) with a mask that leaves every third out."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return d.select("doc_id", ids.alias("input_ids")).withColumn("loss_mask", F.transform("input_ids", lambda x, i: F.when(i % 3 == 2, 0).otherwise(1)))


TOKENS = "tok AS (SELECT doc_id, unnest(list_transform(string_split(text, ' '), lambda w: length(w))) AS token, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents)"


@query("A01_token_counts", f"WITH {TOKENS} SELECT token, count(*) AS n, min(doc_id) AS first_row FROM tok WHERE i % 3 <> 2 GROUP BY token")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.token_counts(tokens(spark, sf_dir), order="doc_id")


@query("A02_F15_token_counts_truncated", f"WITH {TOKENS} SELECT token, count(*) AS n FROM tok WHERE i % 3 <> 2 AND i < 100 GROUP BY token")
def token_counts_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.token_counts(tokens(spark, sf_dir), max_length=100, vocab_size=1 << 20).select("token", "n")


TOP = f"""{TOKENS}, counts AS (SELECT token, count(*) AS n, min(doc_id) AS first_row FROM tok WHERE i % 3 <> 2 GROUP BY token),
    every AS (SELECT token, n, first_row FROM counts UNION ALL SELECT id, 0, NULL FROM (SELECT id FROM range(512) r(id) WHERE id NOT IN (SELECT token FROM counts) ORDER BY id LIMIT 64)),
    best AS (SELECT * FROM every ORDER BY n DESC, first_row NULLS LAST, token LIMIT 64)"""


@query("A03_U03_top_tokens", f"WITH {TOP} SELECT row_number() OVER (ORDER BY token) - 1 AS draft_id, token AS target_id, token - (row_number() OVER (ORDER BY token) - 1) AS shift, n FROM best")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.top_tokens(vocab.token_counts(tokens(spark, sf_dir), order="doc_id"), 64, 512)


@query("A03_coverage", f"WITH {TOP}, b8 AS (SELECT token FROM (SELECT * FROM every ORDER BY n DESC, first_row NULLS LAST, token LIMIT 8)) SELECT sum(n)::BIGINT AS total, (sum(n) FILTER (token IN (SELECT token FROM b8)))::BIGINT AS kept, sum(n) FILTER (token IN (SELECT token FROM b8)) / sum(n) AS coverage FROM counts")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = vocab.token_counts(tokens(spark, sf_dir), order="doc_id")
    return vocab.coverage(counts, vocab.top_tokens(counts, 8, 512))


@query("F16_mapping_consistency", f"WITH {TOP} SELECT token AS target_id, 'mapping' AS only_in FROM best WHERE token % 10 = 7 UNION ALL SELECT 100000, 'members'")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vocab.top_tokens(vocab.token_counts(tokens(spark, sf_dir), order="doc_id"), 64, 512)
    members = m.select(F.col("target_id"), (F.col("target_id") % 10 != 7).alias("member")).unionByName(spark.createDataFrame([(100000, True)], "target_id int, member boolean").withColumn("target_id", F.col("target_id").cast(m.schema["target_id"].dataType)))
    return vocab.inconsistencies(m, members)


@query("F08_minimum_supervised", f"WITH {TOKENS} SELECT doc_id FROM tok GROUP BY doc_id HAVING count(*) FILTER (i % 3 <> 2) >= 40")
def minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).filter(A.mask_count(F.col("loss_mask")) >= 40).select("doc_id")


@query("F09_adjacent_pair", "SELECT doc_id, len(string_split(text, ' ')) >= 2 AND doc_id % 2 = 0 AS pair FROM documents")
def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("input_ids", lambda x, i: F.when((F.col("doc_id") % 2 == 0) | (i % 2 == 0), 1).otherwise(0))
    return tokens(spark, sf_dir).select("doc_id", A.has_adjacent_pair(mask).alias("pair"))


@query("W17_sample_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || source || ':' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sample_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5, SEED)


@query(
    "W18_nested_depths",
    """WITH base AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
    d1 AS (SELECT g, p, n FROM (SELECT b.g, b.p, b.n, row_number() OVER (PARTITION BY b.g ORDER BY md5('43:' || b.g || ':' || b.p), b.p) AS r FROM base b JOIN base a ON a.g = b.g AND a.p + 1 = b.p) WHERE r <= floor(n * 0.7)),
    d2 AS (SELECT g, p, n FROM (SELECT b.g, b.p, b.n, row_number() OVER (PARTITION BY b.g ORDER BY md5('44:' || b.g || ':' || b.p), b.p) AS r FROM base b JOIN d1 a ON a.g = b.g AND a.p + 1 = b.p) WHERE r <= floor(n * 0.49))
    SELECT g, p, 0 AS depth FROM base UNION ALL SELECT g, p, 1 FROM d1 UNION ALL SELECT g, p, 2 FROM d2""",
)
def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("g"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("p"))
    return order.nested_depths(rows, "g", "p", 3, 0.7, 0.2, SEED)


@query("W21_retention", "SELECT o_orderkey AS step FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS r, o_totalprice = (SELECT max(o_totalprice) FROM orders) AS best FROM orders) WHERE r <= 3 OR best")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    best = o.agg(F.max("o_totalprice").alias("top"))
    rows = o.crossJoin(F.broadcast(best)).select(F.col("o_orderkey").alias("step"), (F.col("o_totalprice") == F.col("top")).alias("is_best"))  # one row
    return order.retained(rows, 3).select("step")


@query("E03_pad_batch", f"WITH {TOKENS}, s AS (SELECT doc_id, doc_id // 16 AS batch, count(*) AS size, sum(token) AS total FROM tok GROUP BY doc_id) SELECT doc_id, batch, (ceil(max(size) OVER (PARTITION BY batch) / 8.0) * 8)::BIGINT AS n, total::BIGINT AS total FROM s")
def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), "input_ids", "loss_mask")
    out = collate.pad_batch(rows, {"input_ids": 0, "loss_mask": 0}, multiple=8)
    return out.select("doc_id", "batch", F.size("input_ids").cast("bigint").alias("n"), F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("E04_concat_features", f"WITH {TOKENS} SELECT doc_id // 16 AS batch, count(*) AS n, md5(string_agg(token, ',' ORDER BY doc_id, i)) AS digest FROM tok GROUP BY 1")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), F.col("input_ids").alias("x"))
    out = collate.concat_features(rows, "batch", "doc_id", ["x"])
    return out.select("batch", F.size("x").cast("bigint").alias("n"), F.md5(F.array_join("x", ",").cast("binary")).alias("digest"))


@query("E07_sequence_slices", f"WITH {TOKENS}, s AS (SELECT doc_id, count(*) AS size FROM tok GROUP BY doc_id), r AS (SELECT doc_id, ceil(size / 4.0)::BIGINT AS part, unnest(range(0, 4)) AS rank FROM s) SELECT r.doc_id, rank::INT AS rank, part + 2 AS n, coalesce((SELECT sum(token) FROM tok t WHERE t.doc_id = r.doc_id AND i >= rank * part AND i < (rank + 1) * part + 2), 0)::BIGINT AS total FROM r")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collate.sequence_slices(tokens(spark, sf_dir).select("doc_id", "input_ids"), "input_ids", 4, overlap=2)
    return out.select("doc_id", "rank", F.size("input_ids").cast("bigint").alias("n"), F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("E08_shift", "SELECT vec_id, embedding[2] AS left0, embedding[1] AS right1 FROM embeddings")
def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, zero = F.col("embedding"), F.lit(0).cast("float")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get(A.shift_left(e, zero), F.lit(0)).alias("left0"), F.get(A.shift_right(e, zero), F.lit(1)).alias("right1"))


@query("E10_anchor_blocks", f"WITH {TOKENS}, a AS (SELECT doc_id, unnest([0, 5, 11]) AS anchor FROM documents), b AS (SELECT doc_id, anchor, unnest(range(0, 4)) AS o FROM a) SELECT b.doc_id, anchor, o::INT AS \"offset\", coalesce(t.token, 0)::INT AS label, coalesce(t.i % 3 <> 2, false) AS valid FROM b LEFT JOIN tok t ON t.doc_id = b.doc_id AND t.i = anchor + o")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).withColumn("anchors", F.array(F.lit(0), F.lit(5), F.lit(11)))
    return collate.anchor_blocks(rows, 4)


@query("E11_unroll", f"WITH {TOKENS} SELECT d.doc_id, s::INT AS step, coalesce((SELECT token FROM tok t WHERE t.doc_id = d.doc_id AND t.i = s), 0)::INT AS first_token FROM (SELECT doc_id, unnest(range(0, 5)) AS s FROM documents) d")
def unrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collate.unroll(tokens(spark, sf_dir), 5).select("doc_id", "step", F.coalesce(F.get("input_ids", F.lit(0)), F.lit(0)).alias("first_token"))


@query("E12_segment_ids", "SELECT doc_id, '0,0,1,2,2,2,-1' AS ids FROM documents")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = A.segment_ids(F.array(F.lit(2), F.lit(1), F.lit(3)), F.lit(7))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids, ",").alias("ids"))


@query("K05_file_groups", "SELECT 'rows_' || (o_orderkey // 2000 * 2000) || '-' || (o_orderkey // 2000 * 2000 + 2000) AS grp, count(*) AS n FROM orders GROUP BY 1")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).groupBy(collate.file_group(F.col("o_orderkey")).alias("grp")).agg(F.count("*").alias("n"))


@query(
    "M20_block_mask",
    """WITH k AS (SELECT l_orderkey AS doc, l_linenumber AS pos FROM lineitem),
    q AS (SELECT doc, a AS anchor, a + o AS pos FROM (SELECT DISTINCT doc FROM k), (SELECT unnest([2, 4]) AS a), (SELECT unnest([0, 1]) AS o))
    SELECT q.doc, q.anchor, q.pos AS q_pos, count(*) AS seen FROM q JOIN (SELECT doc, NULL AS anchor, pos FROM k UNION ALL SELECT * FROM q) k ON k.doc = q.doc AND ((k.anchor IS NULL AND k.pos < q.anchor AND k.pos >= q.anchor - 3) OR k.anchor = q.anchor) GROUP BY 1, 2, 3""",
)
def block_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(None).cast("int").alias("anchor"), F.col("l_linenumber").cast("int").alias("pos"))
    q = k.select("doc").distinct().select("doc", F.explode(F.array(F.lit(2), F.lit(4))).alias("anchor")).select("doc", "anchor", F.explode(F.array(F.lit(0), F.lit(1))).alias("o")).select("doc", "anchor", (F.col("anchor") + F.col("o")).alias("pos"))
    return collate.block_mask(q, k.unionByName(q), window=3).groupBy("doc", "anchor", "q_pos").agg(F.count("*").alias("seen"))


