import gzip
import os

import pytest

from chatloom.operators import collate, contracts, ledger, registries, templates, tokenizers, workers
from chatloom.sources import readers, sinks
from chatloom.streaming import refs, tail


def slow_queue(events):
    pending, state = [], {}
    for event, sample, count in events:
        if event == "put" and sample not in pending and state.get(sample) != "leased":
            pending.append(sample)
            state.pop(sample, None)
        elif event == "get":
            for s in pending[:count]:
                state[s] = "leased"
            pending = pending[count:]
        elif event == "ack" and state.get(sample) == "leased":
            state[sample] = "acked"
        elif event == "retry":
            state.pop(sample, None)
            if sample not in pending:
                pending.append(sample)
        elif event == "fail" and sample in state:
            state[sample] = "failed"
    return {s: ("pending", i) for i, s in enumerate(pending)} | {s: (x, None) for s, x in state.items()}


def test_lease_queue_against_a_plain_one(spark):
    import random

    rng = random.Random(4)
    logs = {q: [(rng.choice(["put", "put", "get", "ack", "retry", "fail"]), f"s{rng.randrange(9)}", rng.randint(1, 3)) for _ in range(60)] for q in range(5)}
    rows = [(q, i, e, s, c) for q, log in logs.items() for i, (e, s, c) in enumerate(log)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "queue bigint, seq bigint, event string, sample_id string, count int")
    got = {}
    for r in ledger.lease_queue(df).collect():
        got.setdefault(r["queue"], {})[r["sample_id"]] = (r["state"], r["place"])
    assert got == {q: slow_queue(log) for q, log in logs.items()}
    assert ledger.lease_queue(df.limit(0)).count() == 0


def test_tail_takes_complete_lines_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "PIECE", 37)
    monkeypatch.setattr(tail, "BLOCK", 16)
    (tmp_path / "log").mkdir()
    lines = [f"line {i} " + "é" * (i % 40) for i in range(200)]
    a = tmp_path / "log" / "a.jsonl"
    a.write_text("".join(x + "\n" for x in lines) + "not yet", encoding="utf-8")
    follow = lambda: tail.drain(tail.follow(spark, str(tmp_path / "log")), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [r["value"] for r in follow().orderBy("offset").collect()] == lines
    with a.open("a") as f:
        f.write(" but now\n\nmore")
    (tmp_path / "log" / "b.jsonl").write_text("other\n")
    out = follow()
    assert sorted(r["value"] for r in out.collect()) == sorted([*lines, "not yet but now", "", "other"])
    end, parts = tail.scan(str(tmp_path / "log"), {str(a): 0})
    assert end[str(a)] == a.stat().st_size - len("more") and sum(p.high - p.low for p in parts) == sum(end.values())
    assert tail.scan(str(tmp_path / "log"), end)[1] == []


def test_captures_isolate_failures_and_retry(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(12)], "k bigint, t string").repartition(3)

    def work(row, attempt):
        if row["k"] == 3:
            raise ValueError("never")
        if row["k"] % 4 > attempt:
            raise workers.Retry("later")
        return {"n": len(row["t"])}

    out = {r["k"]: r for r in workers.produce(rows, work, "n bigint", 3).collect()}
    assert out[3]["status"] == "failed" and out[3]["attempts"] == 1 and out[7]["attempts"] == 3 and out[7]["error"] == "later"
    assert [out[k]["n"] for k in (0, 1, 2, 4)] == [0, 1, 2, 4] and out[2]["attempts"] == 3
    assert workers.produce(rows.limit(0), work, "n bigint", 3).count() == 0
    left = workers.capture_offline(rows, "k", str(tmp_path / "o"), lambda r, a: {"n": 1 // (r["k"] % 5)}, "n bigint").collect()
    assert sorted(r["k"] for r in left) == [0, 5, 10]
    assert workers.capture_offline(rows, "k", str(tmp_path / "o"), lambda r, a: {"n": 0}, "n bigint").count() == 0
    assert spark.read.parquet(str(tmp_path / "o")).filter("n = 0").count() == 3 + 6  # those of before stay


def test_loader_hands_out_in_order_and_returns_the_unfinished(spark):
    loader = workers.Loader(spark.range(20).repartition(5), "id", 6)
    seen = []
    for batch in loader:
        seen += [r["id"] for r in batch]
        if len(seen) < 18:
            loader.done(batch)
    assert seen == list(range(20)) and loader.finished == 2
    lost, again = loader.close(lambda b: len(b) < 6)
    assert [len(b) for b in lost] == [2] and [b[0]["id"] for b in again] == [12]


def test_registries():
    r = registries.Registry("thing")
    r.add("a", 1)
    with pytest.raises(ValueError, match="registered"):
        r.add("a", 2)
    with pytest.raises(KeyError, match="known: a"):
        r.get("b")


def test_algorithms_name_missing_features(spark):
    registries.DRAFTS.add("d", {})
    registries.ALGORITHMS.add("needs-much", registries.Algorithm(("input_ids", "hidden"), collate.normalize_sample, "d"))
    with pytest.raises(ValueError, match="hidden"):
        registries.prepared("needs-much", spark.createDataFrame([([1],)], "input_ids array<int>"), 4)


def test_labels_over_a_tokenizer_file(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    tokenize = tokenizers.FileTokenizer(path)
    text = "<|im_start|>user\nhello there<|im_end|>\n<|im_start|>assistant\nGeneral, 漢字!<|im_end|>\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, text string")
    out = {r["id"]: r for r in templates.label_texts(df, "qwen", tokenize=tokenize).collect()}
    assert tokenize.text([i for i, m in zip(out[1]["input_ids"], out[1]["loss_mask"], strict=True) if m]) == "General, 漢字!<|im_end|>\n"
    assert out[2]["input_ids"] == out[3]["input_ids"] == []
    with pytest.raises(ValueError, match="come back"):
        tokenizers.FileTokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))


def test_files_that_fail_have_an_error(spark, tmp_path):
    for name, body in (("a", '{"n": 1}'), ("b", "["), ("c", "[1]")):
        (tmp_path / f"{name}.json").write_text(body)
    out = {os.path.basename(r["path"]): (r["n"], r["error"]) for r in readers.fetch_features(spark, str(tmp_path), "n int").collect()}
    assert out == {"a.json": (1, None), "b.json": (None, "not a feature file"), "c.json": (None, "not a feature file")}
    with pytest.raises(ValueError):
        readers.concat_jsonl(spark, ["a.jsonl", "b.csv"], "n int")


def test_whole_files_are_those_of_sparks_reader(spark, tmp_path, monkeypatch):
    """Many files in few tasks; those that can't be read have an error, also behind a broken link."""
    monkeypatch.setattr(readers, "MANY", 7)
    for i in range(120):
        at = tmp_path / f"f {i % 3}" / "é%20#" / ("_temporary" if i == 5 else "deep" if i % 2 else "_k=1")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"n={i}[{{'}}+&^ü.json").write_bytes(b'{\n"n": %d}' % i if i % 4 else b"\xff[")
    (tmp_path / "top.json").write_text("")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "p.json.gz").write_bytes(gzip.compress(b'{"n": 7}'))
    want = spark.read.option("recursiveFileLookup", True).text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_path AS path", "value")
    for uri in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        got = readers.whole_files(spark, uri)
        more = [r["path"] for r in got.exceptAll(want).collect()]  # Spark has no row for empty files
        assert got.count() == 121 and want.exceptAll(got).isEmpty() and [os.path.basename(x) for x in more] == ["top.json"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    tasks = [x.rdd.getNumPartitions() for x in (readers.whole_files(spark, str(tmp_path)), want.select("*"))]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks[0] < 20 < tasks[1]
    (tmp_path / "gone.json").symlink_to(tmp_path / "nothing")
    errors = readers.fetch_features(spark, str(tmp_path), "n int").filter("error IS NOT NULL")
    assert errors.count() == 30 + 2  # every fourth, the empty one and the broken link


@pytest.mark.parametrize("mounted", [True, False])
def test_each_row_has_its_own_file(spark, tmp_path, monkeypatch, mounted):
    if not mounted:
        monkeypatch.setattr(sinks, "local_path", lambda *_: None)
        monkeypatch.setattr(readers, "local_path", lambda *_: None)
    rows = [(f"k{i % 20}/é", f"text {i}\n") for i in range(40)]
    for i in range(2):
        sinks.write_each(spark.createDataFrame(rows, "k string, t string").repartition(3), f"file://{tmp_path}/{i}", "k", "t")
        out = readers.whole_files(spark, f"{tmp_path}/{i}").collect()
        assert sorted(r["value"].rstrip("\n") for r in out) == sorted(t.rstrip("\n") for _, t in rows) and len({r["path"] for r in out}) == 40


def test_results_replace_their_own_benchmark_only(spark, tmp_path):
    write = lambda *rows: sinks.write_results(spark.createDataFrame(rows, "benchmark string, v int"), str(tmp_path / "r"))
    write(("a", 1), ("b", 2))
    write(("b", 3))
    assert sorted((r["benchmark"], r["v"]) for r in spark.read.json(str(tmp_path / "r")).collect()) == [("a", 1), ("b", 3)]


def test_publishing_again_replaces(spark, tmp_path):
    for batch, ids in ((0, ["a"]), (1, ["b", "c"]), (1, ["b", "c"])):
        refs.publish(spark.createDataFrame([(i,) for i in ids], "sample_id string"), batch, str(tmp_path))
    assert sorted((r["batch"], r["sample_id"]) for r in refs.published(spark, str(tmp_path), "sample_id string").collect()) == [(0, "a"), (1, "b"), (1, "c")]


def test_handshakes_count_null_as_a_value(spark):
    rows = spark.createDataFrame([((1, None), (1, None, 5)), ((1, 2), (1, None, 0))], "ours struct<v: int, s: int>, theirs struct<v: int, s: int, total_steps: int>")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(contracts.handshake(F.col("ours"), F.col("theirs"), ["v", "s"])).collect()] == [[], ["s", "total_steps"]]
