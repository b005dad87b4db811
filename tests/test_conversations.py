import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as X
from chatloom.operators import expand, normalize, presets, templates, validate
from chatloom.schemas import CONVERSATION


def msg(role, content, reasoning=None):
    return (role, content, reasoning, None, None, None)


def row(spark, id_, messages, status="success"):
    return spark.createDataFrame([(id_, status, messages, None)], CONVERSATION)


OK = [msg("user", "q"), msg("assistant", "a")]


def error(df, **kw):
    return df.select(validate.row_error(**kw).alias("e")).first()["e"]


@pytest.mark.parametrize(
    "messages, kw, text",
    [
        ([*OK, msg("user", "again")], {}, "must end with an assistant"),
        ([msg("user", "q"), msg("assistant", "a", "r")], {"expect_non_reasoning": True}, "reasoning_content"),
        (OK, {"expect_reasoning": True}, "empty reasoning_content"),
        ([msg("user", "q"), msg("assistant", "<THINK> a")], {"strict_think_markers": True}, "thinking marker"),
        ([msg("user", " 　")], {}, "content must be a non-empty string"),
        ([], {}, "non-empty list"),
        (None, {}, "non-empty list"),
    ],
)
def test_row_errors(spark, messages, kw, text):
    assert text in error(row(spark, "x", messages), **kw)


def test_valid_and_status(spark):
    assert error(row(spark, "x", OK)) is None
    assert error(row(spark, "x", OK, "error")) == "status must be 'success'"
    assert "id must be" in error(row(spark, " ", OK))


def test_report_counts_duplicates_and_emptiness(spark):
    rows = row(spark, "x", OK).unionByName(row(spark, "x", OK)).withColumn("line", F.lit(1))
    r = validate.dataset_report(rows, validate.row_error()).first()
    assert (r["rows"], r["assistant_messages"], r["duplicate_rows"], r["first_error"]) == (2, 2, 1, None)
    assert validate.dataset_report(rows.limit(0), validate.row_error()).first()["first_error"] == "dataset is empty"


def test_expansion(spark):
    messages = [msg("system", "s"), msg("user", "u1"), msg("assistant", "a1", "r1"), msg("user", "u2"), msg("assistant", "a2", "r2")]
    out = expand.expand_events(row(spark, "abc", messages).withColumn("source_row_index", F.lit(7))).orderBy("assistant_turn_index").collect()
    assert [r["id"] for r in out] == ["abc#turn0", "abc#turn1"]
    assert [[m["reasoning_content"] for m in r["conversations"]] for r in out] == [[None, None, "r1"], [None, None, None, None, "r2"]]


def test_reasoning_rules(spark):
    bad = row(spark, "x", [msg("assistant", "a", "r")])
    assert "expected user" in bad.select(validate.reasoning_error(F.col("conversations")).alias("e")).first()["e"]


def test_sharegpt_counts_what_it_skips(spark):
    rows = spark.createDataFrame([(7, [("system", "ignored"), ("human", "question"), ("gpt", "answer")])], "id bigint, conversations array<struct<from string, value string>>")
    r = presets.prepare("sharegpt", rows).first()
    assert r["id"] == "7" and r["skipped"] == 1
    assert [(m["role"], m["content"]) for m in r["conversations"]] == [("user", "question"), ("assistant", "answer")]


def test_code_alpaca_ids(spark):
    rows = spark.createDataFrame([("i", "", "o"), ("i", 'text = "Hello World!"', "o"), ("i", "", "o")], "instruction string, input string, output string")
    out = presets.prepare("codealpaca-20k", rows).collect()
    assert out[0]["conversations"][0]["content"] == "i"
    assert out[1]["conversations"][0]["content"] == 'i\n\ntext = "Hello World!"'
    assert out[0]["id"] == out[2]["id"] != out[1]["id"]


def test_unknown_roles_and_sets(spark):
    rows = spark.createDataFrame([("p", [("robot", "x")])], "prompt_id string, messages array<struct<role string, content string>>")
    with pytest.raises(Exception, match="Unsupported"):
        presets.prepare("ultrachat", rows).collect()
    with pytest.raises(ValueError, match="pictures"):
        presets.prepare("sharegpt4v", rows)


def test_leading_assistant_is_dropped(spark):
    raw = [("gpt", "orphan assistant"), ("human", "question"), ("gpt", "answer")]
    rows = spark.createDataFrame([(raw,)], "m array<struct<from string, value string>>")
    out = rows.select(validate.repair_structure(normalize.normalize_messages(F.col("m"), ["from", "value"])).alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in out] == [("user", "question"), ("assistant", "answer")]


def test_truncation_compares_with_the_message_before(spark):
    raw = [("user", "u"), ("assistant", "a"), ("assistant", "b"), ("user", "v")]
    rows = spark.createDataFrame([(raw,)], "m array<struct<role string, content string>>")
    out = rows.select(validate.repair_structure(F.col("m")).alias("m")).first()["m"]
    assert [m["content"] for m in out] == ["u", "a"]


def test_supervised_text_of_an_event():
    text = "<|im_start|>user\nu1<|im_end|>\n<|im_start|>assistant\na1<|im_end|>\n<|im_start|>user\nu2<|im_end|>\n<|im_start|>assistant\n<think>\nr2\n</think>\n\na2<|im_end|>\n"
    for last in (False, True):
        ids, mask = templates.label(text, templates.TEMPLATES["qwen3.5"], last_only=last)
        taught = "".join(chr(i) for i, m in zip(ids, mask, strict=True) if m)
        assert "r2" in taught and "a2" in taught and "a1" not in taught


def test_ignored_tokens_and_truncation():
    t = templates.TEMPLATES["qwen3-instruct"]
    text = "<|im_start|>assistant\n<think>\n\n</think>\n\nhi<|im_end|>\n"
    ids, mask = templates.label(text, t)
    assert "".join(chr(i) for i, m in zip(ids, mask, strict=True) if m) == "hi<|im_end|>\n"
    assert len(templates.label(text, t, max_length=5)[0]) == 5


def test_templates_are_registered_once():
    assert len(templates.TEMPLATES) == 26
    with pytest.raises(ValueError):
        templates.register("qwen", templates.TEMPLATES["qwen"])


def test_native_labels_equal_span_labels(spark):
    rows = row(spark, "x", [msg("user", "u"), msg("assistant", "a1"), msg("user", "v"), msg("assistant", "a2")])
    t = templates.TEMPLATES["qwen"]
    native = templates.label_rendered(rows, t).first()
    assert templates.label(native["text"], t)[1] == list(native["loss_mask"])


def slow_mask(places, inside, ignored, whole):
    mask, at, cut = [0] * len(places), 0, 0
    for i, (s, e) in enumerate(places):
        while at < len(inside) and inside[at][1] <= s:
            at += 1
        while cut < len(ignored) and ignored[cut][1] <= s:
            cut += 1
        if at < len(inside) and inside[at][0] <= s and (not whole or e <= inside[at][1]):
            mask[i] = 1
        if cut < len(ignored) and ignored[cut][0] <= s < ignored[cut][1]:
            mask[i] = 0
    return mask


def test_masks_against_a_plain_walk_over_the_tokens():
    rng = random.Random(8)
    for name, t in templates.TEMPLATES.items():
        bits = [x for x in (t.assistant, t.user, t.end, *t.ignored, "<|start|>assistant", "<|start|>user<|message|>", "a", "é漢", "😀\n") if x]
        for _ in range(40):
            text, at, places = "".join(rng.choice(bits) for _ in range(rng.randrange(12))), 0, []
            while at < len(text):
                end = min(len(text), at + rng.randint(1, 9))
                places += [(at, end)] * rng.randint(1, 2)
                at = end
            rng.random() < 0.2 and rng.shuffle(places)
            last, most = rng.random() < 0.5, rng.choice([None, 7])
            ignored = sorted(m.span() for x in t.ignored for m in re.finditer(re.escape(x), text))
            for got, p in ((templates.label(text, t, lambda _: (list(range(len(places))), places), most, last), places), (templates.label(text, t, max_length=most, last_only=last), [(i, i + 1) for i in range(len(text))])):
                assert got[1] == slow_mask(p[:most], templates.spans(text, t, last), ignored, t.parser == "openai-harmony"), (name, text)
            assert templates.label(text, t)[0] == [ord(c) for c in text]


def test_labels_of_a_batch_are_handed_on_in_pieces(monkeypatch):
    """Labels of all texts of a batch at once are many times its size."""
    monkeypatch.setattr(templates, "PIECE", 1000)
    texts = ["<|im_start|>assistant\n" + "x" * (37 * i % 700) + "<|im_end|>\n" for i in range(200)] + [None, "y" * 5000, ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    out = list(templates._label_pieces(iter([batch, batch.slice(0, 0)]), templates.TEMPLATES["qwen"], templates.code_points, None, False))
    assert len(out) > 50 and all(len(b.column("input_ids").flatten()) < 1000 + 5000 for b in out)
    got = pa.Table.from_batches(out).to_pydict()
    assert got["id"] == list(range(len(texts)))
    for text, ids, mask, seen in zip(texts, got["input_ids"], got["loss_mask"], got["attention_mask"], strict=True):
        assert (ids, mask) == templates.label(text or "", templates.TEMPLATES["qwen"]) and seen == [1] * len(ids)


def one(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_extractors(spark):
    assert one(spark, X.last_integer, "a 1,234 b", "none", "x 007", "0") == [1234, -9999999, -9999999, 0]
    assert one(spark, X.math_answer, r"so \boxed{ 42 }", r"\boxed 7 x", "the answer: 3.5, 9", "a 1 b -2", "none") == ["42", "7", "3.5", "-2", None]
    assert one(spark, X.contest_answer, r"\boxed{x = 113}", "Answer: 77 or 5", "use 1000 and 999", "none") == ["113", "77", "999", None]
    assert one(spark, X.choice_letter, "(b)", "Answer: C", "dA", "答案：D", "xyz") == ["B", "C", "D", "D", None]
    assert one(spark, X.text_after, "q Answer: yes Answer: no", "none") == ["yes", None]
    assert one(spark, X.code_block, "t\n```python\nx = 1\n```\n", "def f(a):\n  return a\n\ndef g():\n  pass", " ") == ["x = 1", "def f(a):\n  return a", None]
    assert one(spark, X.marked_code, "[BEGIN]\nx = 1\n[DONE] rest", None) == ["x = 1", None]


def test_python_white_space(spark):
    assert one(spark, X.strip, "　a ", "\x1c b \x1f", "  ") == ["a", "b", ""]


def test_model_names(spark):
    clean = lambda c: X.clean_model_name(c, "Serve-Draft")
    assert one(spark, clean, "org/Serve-Draft-Model", "serve-draft/m", "Serve-Draft", "plain") == ["org/Model", "m", "Serve-Draft", "plain"]


def test_tool_calls_keep_known_fields(spark):
    text = json.dumps([{"id": "c", "x": 1, "function": {"name": "f", "arguments": '{"a": 1}'}}, 3, {"function": {"arguments": "no"}}])
    out = one(spark, normalize.tool_calls, text, "{broken", None)
    assert [(c["id"], c["type"], c["function"]["name"], c["function"]["arguments"]) for c in out[0]] == [("c", "function", "f", '{"a": 1}'), ("", "function", "", "{}")]
    assert out[1:] == [None, None]


def test_channels(spark):
    out = one(spark, normalize.channels, "<|channel|> a<|message|>x\ny<|end|><|channel|>b<|message|> z <|end|>", "plain")
    assert [[tuple(s) for s in x] for x in out] == [[("a", "x\ny"), ("b", "z")], [("text", "plain")]]


def test_index_follows_files_of_any_size(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from chatloom.plans import conversations, registry  # noqa: F401

    at, old = 0, spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "documents.parquet").mkdir()
    for k, n in enumerate((30, 0, 2000, 1, 700, 5000)):  # the largest are packed first
        ids = [(i * 7919) % 100003 for i in range(at, at + n)]
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64())}), tmp_path / "documents.parquet" / f"part-{k}.parquet", row_group_size=600)
        at += n
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.sql(registry.ORACLES["P10_add_index"]).fetchall())
    try:
        for size in ("128m", "9k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = registry.QUERIES["P10_add_index"](spark, str(tmp_path)).select("old", "id").collect()
            assert sorted(map(tuple, out)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
