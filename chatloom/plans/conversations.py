"""Queries over conversations: validation, repair, expansion, rendering, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.functions import text as X
from chatloom.operators import expand, normalize, presets, templates, validate
from chatloom.plans.registry import query, table

#: The table's conversations are all valid in order; these changes make every kind of error.
ALTERED = """
    altered AS (
      SELECT conv_id, turn,
             CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'tool' ELSE role END AS role,
             CASE WHEN conv_id % 13 = 5 AND turn = 2 THEN '  ' ELSE text END AS text
      FROM conversations WHERE NOT (conv_id % 7 = 2 AND turn = 0))"""


def altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("NOT (conv_id % 7 = 2 AND turn = 0)")
    role = F.expr("CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'tool' ELSE role END")
    text = F.expr("CASE WHEN conv_id % 13 = 5 AND turn = 2 THEN '  ' ELSE text END")
    return c.withColumns({"role": role, "text": text})


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with made-up status, and reasoning for some assistants' messages."""
    rows = validate.nest(altered(spark, sf_dir)).withColumn("n", F.col("id").cast("bigint"))
    reasoning = lambda i: F.when((F.col("n") % 3 == 0) & (i % 4 != 3), F.concat(F.lit("r"), i.cast("string")))
    messages = F.transform("conversations", lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(m["role"] == "assistant", reasoning(i)).alias("reasoning_content")))
    return rows.withColumns({"conversations": messages, "status": F.when(F.col("n") % 17 == 4, "error").otherwise("success")})


#: First errors: i is a message's place, seen whether a user or assistant came before.
ERRORS = f"""{ALTERED},
    placed AS (
      SELECT *, row_number() OVER w - 1 AS i,
             coalesce(sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS seen
      FROM altered WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    turns AS (
      SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 'assistant' ELSE 'user' END AS want
      FROM placed WHERE NOT (role = 'system' AND NOT seen) OR trim(text) = ''),
    wrong AS (
      SELECT conv_id, i,
             CASE WHEN trim(text) = '' THEN 'message ' || i || ' content must be a non-empty string'
                  WHEN role NOT IN ('user', 'assistant') THEN 'message ' || i || ' has unsupported role ''' || role || ''''
                  WHEN role <> want THEN 'message ' || i || ' expected role ''' || want || ''', got ''' || role || '''' END AS error,
             CASE WHEN trim(text) = '' THEN 'Invalid message content at position ' || i || ': expected non-empty string'
                  WHEN role NOT IN ('user', 'assistant') THEN 'Invalid message role: ' || role
                  WHEN role <> want AND NOT seen AND role = 'assistant' THEN 'Data starts with an assistant message'
                  WHEN role <> want THEN 'Invalid conversation role order at position ' || i || ': expected ' || want || ', got ' || role END AS regeneration
      FROM turns),
    firsts AS (SELECT conv_id, min_by(error, i) AS error, min_by(regeneration, i) AS regeneration FROM wrong WHERE error IS NOT NULL GROUP BY conv_id),
    ends AS (SELECT conv_id, count(*) AS messages, max_by(role, turn) AS last_role, count(*) FILTER (role = 'assistant') AS assistants, bool_or(role IN ('user', 'assistant')) AS any_turn FROM altered GROUP BY conv_id),
    judged AS (
      SELECT e.*, coalesce(f.error, CASE WHEN NOT any_turn THEN 'conversation has no user message' END) AS error,
             coalesce(f.regeneration, CASE WHEN NOT any_turn THEN 'Data does not contain a user message' END) AS regeneration
      FROM ends e LEFT JOIN firsts f ON e.conv_id = f.conv_id)"""


@query(
    "F01_A05_conversation_status",
    f"""WITH {ERRORS}
    SELECT CASE WHEN error IS NOT NULL THEN 'invalid' WHEN last_role <> 'assistant' THEN 'trailing_user' ELSE 'ok' END AS status,
           count(*) AS conversations, sum(assistants)::BIGINT AS assistant_messages, sum(messages)::BIGINT AS messages
    FROM judged GROUP BY 1""",
)
def conversation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.nest(altered(spark, sf_dir))
    status = F.when(validate.conversation_error(F.col("conversations")).isNotNull(), "invalid").when(F.element_at("conversations", -1)["role"] != "assistant", "trailing_user").otherwise("ok")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("conversations"), F.sum(validate.assistant_count(F.col("conversations"))).alias("assistant_messages"), F.sum(F.size("conversations")).alias("messages"))


@query("F01_first_error", f"WITH {ERRORS} SELECT conv_id::VARCHAR AS id, error, regeneration FROM judged")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.nest(altered(spark, sf_dir))
    return rows.select("id", validate.conversation_error(F.col("conversations")).alias("error"), validate.conversation_error(F.col("conversations"), "regeneration").alias("regeneration"))


@query("F01_flat_first_error", f"WITH {ERRORS} SELECT conv_id, error FROM firsts")
def flat_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.flat_order_errors(altered(spark, sf_dir))


ROW_ERRORS = f"""{ERRORS},
    rowed AS (
      SELECT j.*, conv_id % 17 = 4 AS failed,
             (SELECT min(i) FROM placed p WHERE p.conv_id = j.conv_id AND p.role = 'assistant' AND p.conv_id % 3 = 0 AND p.i % 4 <> 3) AS reasoned
      FROM judged j),
    rowj AS (
      SELECT *, CASE WHEN failed THEN 'status must be ''success''' WHEN error IS NOT NULL THEN error
                  WHEN reasoned IS NOT NULL THEN 'assistant message ' || reasoned || ' has non-empty reasoning_content'
                  WHEN assistants = 0 THEN 'conversation has no assistant message'
                  WHEN last_role <> 'assistant' THEN 'conversation must end with an assistant message' END AS row_error
      FROM rowed)"""


@query("F03_row_error", f"WITH {ROW_ERRORS} SELECT conv_id::VARCHAR AS id, row_error AS error FROM rowj")
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).select("id", validate.row_error(expect_non_reasoning=True).alias("error"))


@query(
    "F04_A07_dataset_report",
    f"""WITH {ROW_ERRORS}
    SELECT count(*) AS rows, coalesce(sum(CASE WHEN row_error IS NULL THEN assistants END), 0)::BIGINT AS assistant_messages,
           (count(*) - count(DISTINCT conv_id % 90))::BIGINT AS duplicate_rows,
           min(CASE WHEN row_error IS NOT NULL THEN conv_id END) AS first_bad_line,
           min_by(row_error, CASE WHEN row_error IS NOT NULL THEN conv_id END) AS first_error
    FROM rowj""",
)
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested(spark, sf_dir).withColumn("error", validate.row_error(expect_non_reasoning=True)).withColumn("id", (F.col("n") % 90).cast("string"))
    return validate.dataset_report(rows, F.col("error"), "n")


@query(
    "F05_reasoning_error",
    f"""WITH {ERRORS},
    bare AS (SELECT conv_id, min(i) AS i FROM placed WHERE role = 'assistant' AND NOT (conv_id % 3 = 0 AND i % 4 <> 3) GROUP BY conv_id),
    lead AS (SELECT conv_id, min_by(role, i) AS role, min(i) AS i FROM placed WHERE role <> 'system' GROUP BY conv_id)
    SELECT j.conv_id::VARCHAR AS id,
           CASE WHEN l.role = 'assistant' THEN 'Invalid conversation role order at position ' || l.i || ': expected user, got assistant'
                WHEN regeneration IS NOT NULL THEN regeneration
                WHEN b.i IS NOT NULL THEN 'Invalid assistant reasoning_content at position ' || b.i || ': expected non-empty string'
                WHEN assistants = 0 THEN 'Data does not contain an assistant message'
                WHEN last_role <> 'assistant' THEN 'Conversation ends with a user message' END AS error
    FROM judged j LEFT JOIN bare b ON j.conv_id = b.conv_id LEFT JOIN lead l ON j.conv_id = l.conv_id""",
)
def reasoning_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).select("id", validate.reasoning_error(F.col("conversations")).alias("error"))


@query("F02_think_marker", "SELECT doc_id, lower(text) LIKE '%<think>%' OR lower(text) LIKE '%</think>%' AS marked FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<THINK>' || text WHEN 1 THEN text || '</Think>' ELSE text END AS text FROM documents)")
def think_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN '<THINK>' || text WHEN 1 THEN text || '</Think>' ELSE text END")
    return table(spark, sf_dir, "documents").select("doc_id", X.has_think_marker(text).alias("marked"))


@query(
    "F06_repair_structure",
    f"""WITH {ALTERED},
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM altered),
    body AS (SELECT p.*, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed p
             WHERE i >= (SELECT min(i) FROM placed u WHERE u.conv_id = p.conv_id AND u.role = 'user')),
    cut AS (SELECT conv_id, min(i) AS i FROM body WHERE (role = 'tool' AND before NOT IN ('assistant', 'tool')) OR (role = 'assistant' AND before NOT IN ('user', 'tool')) GROUP BY conv_id),
    kept AS (SELECT b.conv_id, b.i, b.role FROM body b LEFT JOIN cut c ON b.conv_id = c.conv_id WHERE c.i IS NULL OR b.i < c.i
             UNION ALL SELECT conv_id, 0, 'system' FROM (SELECT DISTINCT conv_id FROM altered))
    SELECT conv_id::VARCHAR AS id, string_agg(role, ',' ORDER BY i) AS roles FROM kept GROUP BY conv_id""",
)
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.nest(altered(spark, sf_dir))
    kept = validate.repair_structure(F.col("conversations"), templates.TEMPLATES["qwen"].system)
    return rows.select("id", F.array_join(F.transform(kept, lambda m: m["role"]), ",").alias("roles"))


EVENTS = f"""{ERRORS},
    valid AS (SELECT conv_id FROM judged WHERE error IS NULL AND last_role = 'assistant'),
    answers AS (SELECT p.conv_id, p.i, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.i) - 1 AS k FROM placed p JOIN valid v ON p.conv_id = v.conv_id WHERE p.role = 'assistant')"""


def valid_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = nested(spark, sf_dir).withColumn("status", F.lit("success")).withColumn("source_row_index", F.col("n"))
    return expand.quarantine(rows, validate.row_error())


@query(
    "E01_P15_generation_events",
    f"""WITH {EVENTS}
    SELECT a.conv_id || '#turn' || a.k AS id, a.conv_id::VARCHAR AS source_id, a.conv_id AS source_row_index, a.k AS assistant_turn_index,
           count(*) AS messages, md5(string_agg(p.role || ':' || p.text, '|' ORDER BY p.i)) AS digest,
           string_agg(CASE WHEN p.i = a.i AND p.role = 'assistant' AND a.conv_id % 3 = 0 AND p.i % 4 <> 3 THEN 'r' || p.i END, ',' ORDER BY p.i) AS reasoning
    FROM answers a JOIN placed p ON p.conv_id = a.conv_id AND p.i <= a.i GROUP BY a.conv_id, a.k""",
)
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expand.expand_events(valid_rows(spark, sf_dir)[0])
    m = F.col("conversations")
    reasoning = F.array_join(F.filter(F.transform(m, lambda x: x["reasoning_content"]), lambda r: r.isNotNull()), ",")
    return out.select(
        "id", "source_id", "source_row_index", "assistant_turn_index", F.size(m).alias("messages"),
        F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").cast("binary")).alias("digest"),
        X.falsy(reasoning).alias("reasoning"),
    )


@query(
    "E02_quarantine",
    f"WITH {ERRORS} SELECT conv_id AS source_row_index, 'skipped' AS status, coalesce(error, CASE WHEN assistants = 0 THEN 'conversation has no assistant message' ELSE 'conversation must end with an assistant message' END) AS error FROM judged WHERE error IS NOT NULL OR last_role <> 'assistant'",
)
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(spark, sf_dir)[1].select("source_row_index", "status", "error")


@query(
    "A06_expansion_stats",
    f"""WITH {EVENTS}, per AS (SELECT conv_id, count(*) AS n FROM answers GROUP BY conv_id)
    SELECT (SELECT count(*) FROM judged) AS input_rows, (SELECT count(*) FROM judged) - (SELECT count(*) FROM valid) AS skipped_rows,
           sum(n)::BIGINT AS output_rows, count(*) FILTER (n > 1) AS multi_turn_rows, avg(n) AS avg_events FROM per""",
)
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = valid_rows(spark, sf_dir)
    return expand.expansion_stats(nested(spark, sf_dir), expand.expand_events(good), bad)


QWEN = ("<|im_start|>assistant\n", "<|im_start|>user\n", "<|im_end|>\n")
RENDER_SQL = """
    parts AS (SELECT conv_id, turn,
      CASE role WHEN 'system' THEN text WHEN 'user' THEN '<|im_start|>user' || chr(10) || text WHEN 'assistant' THEN '<|im_start|>assistant' || chr(10) ELSE '' END AS plain,
      CASE role WHEN 'assistant' THEN text || '<|im_end|>' || chr(10) ELSE '' END AS taught FROM conversations)"""


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.nest(table(spark, sf_dir, "conversations"))


@query("T01_T02_render", f"WITH {RENDER_SQL} SELECT conv_id::VARCHAR AS id, md5(string_agg(plain || taught, '' ORDER BY turn)) AS digest, sum(length(plain || taught))::BIGINT AS chars FROM parts GROUP BY conv_id")
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = templates.render(F.col("conversations"), templates.TEMPLATES["qwen"])
    return plain(spark, sf_dir).select("id", text.alias("t")).select("id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("bigint").alias("chars"))


LABEL_SQL = f"WITH {RENDER_SQL} SELECT conv_id::VARCHAR AS id, sum(length(plain || taught))::BIGINT AS tokens, sum(length(taught))::BIGINT AS supervised FROM parts GROUP BY conv_id"


@query("T04_T05_label_native", LABEL_SQL)
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.label_rendered(plain(spark, sf_dir), templates.TEMPLATES["qwen"])
    return rows.select("id", F.size("loss_mask").cast("bigint").alias("tokens"), A.mask_count(F.col("loss_mask")).cast("bigint").alias("supervised"))


@query("T04_T05_label_spans", LABEL_SQL)
def labelled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain(spark, sf_dir).select("id", templates.render(F.col("conversations"), templates.TEMPLATES["qwen"]).alias("text"))
    out = templates.label_texts(rows, "qwen")
    return out.select("id", F.size("input_ids").cast("bigint").alias("tokens"), A.mask_count(F.col("loss_mask")).cast("bigint").alias("supervised"))


@query(
    "T05_last_turn_labels",
    f"WITH {RENDER_SQL}, last AS (SELECT conv_id, max(turn) AS turn FROM parts WHERE taught <> '' GROUP BY conv_id) SELECT p.conv_id::VARCHAR AS id, coalesce(sum(CASE WHEN p.turn = l.turn THEN length(taught) END), 0)::BIGINT AS supervised FROM parts p LEFT JOIN last l ON p.conv_id = l.conv_id GROUP BY p.conv_id",
)
def last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.label_rendered(plain(spark, sf_dir), templates.TEMPLATES["qwen"], last_only=True)
    return rows.select("id", A.mask_count(F.col("loss_mask")).cast("bigint").alias("supervised"))


@query(
    "T03_render_harmony",
    """WITH p AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS s FROM conversations),
    o AS (SELECT conv_id, turn, s, CASE role WHEN 'system' THEN '<|start|>system<|message|>' || text || '<|end|>' WHEN 'user' THEN '<|start|>user<|message|>' || text || '<|end|>' ELSE '<|start|>assistant<|channel|>final<|message|>' || text || '<|end|>' END AS t FROM p WHERE s IS NULL OR turn >= s)
    SELECT conv_id::VARCHAR AS id, CASE WHEN max(s) IS NULL THEN 1 ELSE 0 END AS preamble, sum(length(t))::BIGINT AS chars FROM o GROUP BY conv_id""",
)
def harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.transform("conversations", lambda x: F.struct(F.when(x["role"] == "assistant", "assistant_final").otherwise(x["role"]).alias("role"), x["content"].alias("content")))
    rows = plain(spark, sf_dir).select("id", templates.render_harmony(m).alias("t"))
    head = len(templates.HARMONY_SYSTEM.format("low"))
    pre = F.startswith("t", F.lit("<|start|>system<|message|>You are ChatGPT"))
    return rows.select("id", F.when(pre, 1).otherwise(0).alias("preamble"), (F.length("t") - F.when(pre, head).otherwise(0)).cast("bigint").alias("chars"))


@query(
    "P12_normalize_messages",
    "SELECT conv_id::VARCHAR AS id, string_agg(CASE WHEN role IN ('user', 'assistant') THEN role ELSE role END || '=' || length(text), ',' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id",
)
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.transform("conversations", lambda m, i: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), F.when(i % 2 == 0, m["content"]).alias("value"), F.when(i % 2 == 1, m["content"]).otherwise("").alias("content")))
    out = normalize.normalize_messages(raw, ["from", "value", "content"])
    return plain(spark, sf_dir).select("id", F.array_join(F.transform(out, lambda m: F.concat(m["role"], F.lit("="), F.length(m["content"]))), ",").alias("shape"))


@query(
    "P02_sharegpt",
    "SELECT conv_id::VARCHAR AS id, count(*) FILTER (role <> 'system') AS kept, count(*) FILTER (role = 'system')::INT AS skipped, coalesce(string_agg(CASE WHEN role <> 'system' THEN role END, ',' ORDER BY turn), '') AS roles FROM conversations GROUP BY conv_id",
)
def sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.transform("conversations", lambda m: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    out = presets.prepare("sharegpt", plain(spark, sf_dir).select("id", raw.alias("conversations")))
    return out.select("id", F.size("conversations").cast("bigint").alias("kept"), "skipped", F.array_join(F.transform("conversations", lambda m: m["role"]), ",").alias("roles"))


@query("P01_ultrachat", "SELECT conv_id::VARCHAR AS id, count(*) AS messages FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def ultrachat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.nest(table(spark, sf_dir, "conversations").filter("role <> 'system'"))
    out = presets.prepare("ultrachat", rows.select(F.col("id").alias("prompt_id"), F.col("conversations").alias("messages")))
    return out.select("id", F.size("conversations").cast("bigint").alias("messages"))


def pairs(spark: SparkSession, sf_dir: str, a: str, b: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.col("lang").alias(b), F.col("text").alias(a), F.col("source").alias("input"))


@query("P04_P07_P11_hashed_pairs", "SELECT doc_id, md5(text || lang) AS id, length(text) AS q, length(lang) AS a FROM documents")
def hashed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.stable_id(F.col("text"), F.col("lang")).alias("id"), F.length("text").cast("bigint").alias("q"), F.length("lang").cast("bigint").alias("a"))


@query("P05_code_alpaca", "SELECT md5(u || lang) AS id, u AS user_content, lang AS answer FROM (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || doc_id ELSE source END AS u FROM documents)")
def code_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("instruction"), F.expr("CASE WHEN doc_id % 2 = 0 THEN cast(doc_id AS string) ELSE '' END").alias("input"), F.col("lang").alias("output"))
    out = presets.prepare("codealpaca-20k", d)
    return out.select("id", F.get("conversations", F.lit(0))["content"].alias("user_content"), F.get("conversations", F.lit(1))["content"].alias("answer"))


@query("P06_open_code_instruct", "SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE md5(source || lang) END AS id, count(*) AS n FROM documents GROUP BY 1")
def open_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr("CASE WHEN doc_id % 3 = 0 THEN cast(doc_id AS string) WHEN doc_id % 3 = 1 THEN '' END").alias("id"), F.col("source").alias("input"), F.col("lang").alias("output"))
    return presets.prepare("opencodeinstruct", d).groupBy("id").agg(F.count("*").alias("n"))


@query("P08_math_qa", "SELECT md5(source || chr(10) || lang || n_chars) AS id, source || chr(10) || lang AS q FROM documents")
def math_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("Problem"), F.col("lang").alias("options"), F.col("n_chars").cast("string").alias("Rationale"))
    return presets.prepare("math_qa", d).select("id", F.get("conversations", F.lit(0))["content"].alias("q"))


@query(
    "P09_sciq",
    """WITH a AS (SELECT doc_id, unnest(['x3', 'x1', 'x2', source]) AS a, unnest([0, 1, 2, 3]) AS i, source, lang || doc_id AS q FROM documents),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0' || chr(31) || q || chr(31) || a), i) AS place FROM a)
    SELECT doc_id, any_value(q) || chr(10) || string_agg(substr('abcd', place::INT, 1) || ') ' || a, chr(10) ORDER BY place) AS q, substr('abcd', min(CASE WHEN a = source THEN place END)::INT, 1) AS label FROM d GROUP BY doc_id""",
)
def sciq(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("x3").alias("distractor3"), F.lit("x1").alias("distractor1"), F.lit("x2").alias("distractor2"), F.col("source").alias("correct_answer"), F.concat("lang", F.col("doc_id").cast("string")).alias("question"), F.col("doc_id").cast("string").alias("support"))
    out = presets.prepare("sciq", d).select(F.get("conversations", F.lit(0))["content"].alias("q"), F.get("conversations", F.lit(1))["content"].alias("a"))
    return out.select(F.regexp_extract("a", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "q", F.regexp_extract("a", r"\nanswer: ([a-d])", 1).alias("label"))


@query("P03_infinity_instruct", "SELECT conv_id::VARCHAR AS id, min_by(text, turn) AS q, max_by(text, turn) AS a FROM conversations GROUP BY conv_id")
def infinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain(spark, sf_dir).select("id", F.col("conversations").alias("conversation"), F.element_at("conversations", -1).alias("generated_message"))
    out = presets.prepare("nebius-llama31-8b-infinity-instruct", rows)
    return out.select("id", F.get("conversations", F.lit(0))["content"].alias("q"), F.get("conversations", F.lit(1))["content"].alias("a"))


@query("P10_add_index", "SELECT doc_id AS old, row_number() OVER () - 1 AS id FROM documents")
def add_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presets.add_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("old")))


@query(
    "P14_channels",
    "SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['analysis', 'final'] ELSE ['text'] END) AS channel, unnest(CASE WHEN doc_id % 2 = 0 THEN [source, lang] ELSE [source] END) AS content FROM documents",
)
def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE WHEN doc_id % 2 = 0 THEN '<|channel|> analysis<|message|>' || source || ' <|end|><|channel|>final<|message|>' || lang || '<|end|>' ELSE source END")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(normalize.channels(c)).alias("x")).select("doc_id", "x.*")


@query(
    "P13_tool_calls",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id ELSE '' END AS id, 'function' AS type, source AS name,
       CASE WHEN doc_id % 3 = 1 THEN '{}' ELSE '{"a":' || doc_id || '}' END AS arguments FROM documents WHERE doc_id % 3 <> 2""",
)
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr(
        """CASE doc_id % 3 WHEN 0 THEN '[7,{"id":"c' || doc_id || '","extra":1,"function":{"name":"' || source || '","arguments":"{\\\\"a\\\\":' || doc_id || '}"}}]'
           WHEN 1 THEN '[{"function":{"name":"' || source || '","arguments":"not json"}}]' ELSE '{broken' END"""
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(normalize.tool_calls(c)).alias("x"))
    return rows.select("doc_id", "x.id", "x.type", "x.function.name", "x.function.arguments")


@query("P22_json_list", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 0 END AS n FROM documents")
def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE doc_id % 3 WHEN 0 THEN '[{\"a\":1},{\"b\":2}]' WHEN 1 THEN 'oops' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(normalize.json_list(c)).alias("n"))


@query(
    "P19_prompts",
    """WITH s AS (SELECT lang, string_agg('Question: ' || source || chr(10) || 'Answer: ' || n_chars || chr(10) || chr(10), '' ORDER BY doc_id) AS shots
                 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY lang)
    SELECT doc_id, md5(shots || 'Question: ' || source || chr(10) || 'Answer:') AS prompt FROM documents JOIN s ON documents.lang = s.lang""",
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked after five examples (the number of shots) of its language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    x = d.withColumn("r", first).filter("r <= 5").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", "source", "n_chars"))).alias("x"))
    q, a = F.transform("x", lambda r: r["source"]), F.transform("x", lambda r: r["n_chars"].cast("string"))
    shots = x.select("lang", normalize.few_shot(q, a).alias("shots"))
    return d.join(shots, "lang").select("doc_id", F.md5(F.concat("shots", F.lit("Question: "), "source", F.lit("\nAnswer:")).cast("binary")).alias("prompt"))


@query("P20_option_lines", "SELECT doc_id, 2 AS n, source || '|' || lang AS options FROM documents")
def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("'What? Options: ' || '\\n A. ' || source || '\\nB.' || lang || '\\nnone'")
    rows = table(spark, sf_dir, "documents").select("doc_id", normalize.option_lines(c).alias("o"))
    return rows.select("doc_id", F.size("o").alias("n"), F.array_join("o", "|").alias("options"))


@query("P21_first_of", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, lang) AS question FROM documents")
def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 2 = 0 THEN source END").alias("problem"), F.col("lang").alias("content"))
    return d.select("doc_id", normalize.first_of(d.columns, "question", "inputs", "problem", "content").alias("question"))
