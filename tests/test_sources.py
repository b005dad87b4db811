import json

import pytest

from chatloom.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_records_are_detected(spark, tmp_path):
    array = write(tmp_path / "a.json", '[{"id": "1"}, {"id": "2"}]')
    lines = write(tmp_path / "b.jsonl", '{"id": "1"}\n\n{"id": "2"}\n')
    for p in (array, lines):
        assert sorted(r["id"] for r in readers.detect_records(spark, p, "id string").collect()) == ["1", "2"]


def test_strict_lines_name_the_bad_one(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"id": "1"}\n[1]\n')
    with pytest.raises(Exception, match="line 2"):
        readers.strict_jsonl(spark, p, "id string").collect()


def test_lenient_lines_count_blanks(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"id": "1"}\n\noops\n{"id": "2"}\n')
    out = readers.lenient_jsonl(spark, p, "id string").orderBy("source_row_index").collect()
    assert [(r["source_row_index"], r["id"], r["error"]) for r in out] == [(0, "1", None), (2, None, "Expected a JSON object"), (3, "2", None)]


def test_safe_conversations(spark, tmp_path):
    rows = [{"conversations": [{"role": "user", "content": {"a": 1}}, 5]}, {"conversations": "x"}, {"text": "t"}]
    p = write(tmp_path / "a.jsonl", "\n".join(map(json.dumps, rows)) + "\nbroken")
    out = readers.safe_conversations(spark, p).collect()
    assert len(out) == 2
    assert json.loads(out[0]["conversations"][0]["content"]) == {"a": 1}
    assert out[1]["text"] == "t"


def test_suffixes(spark):
    with pytest.raises(ValueError):
        readers.read_json(spark, "x.csv")


def test_manifest(spark, tmp_path):
    for n in ("b.bin", "a.bin"):
        write(tmp_path / n, n)
    out = readers.manifest(readers.list_files(spark, str(tmp_path), "*.bin"), "run").orderBy("sample_id").collect()
    assert [r["sample_id"] for r in out] == ["run:00000000", "run:00000001"]
    assert out[0]["uri"].endswith("a.bin")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("é", "success"), ("b", "error")], "t string, status string")
    sinks.write_routed(rows, str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").glob("status=*")} == {"status=success", "status=error"}
    sinks.write_once(rows, str(tmp_path / "o"))
    sinks.write_once(rows.limit(0), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_jsonl(rows, str(tmp_path / "o"))
    with pytest.raises(ValueError):
        sinks.distinct_paths("a", "a")
    assert sinks.loggable(rows.withColumnRenamed("t", "api_key")).columns == ["status"]


def test_mapping_is_published_whole(spark, tmp_path):
    rows = spark.range(3)
    with pytest.raises(ValueError):
        sinks.publish_mapping(rows, 4, str(tmp_path / "m"))


def test_lines_are_numbered_across_files_and_blocks(spark, tmp_path):
    want = []
    for k, n in enumerate((3, 0, 400, 1, 57)):
        lines = [f"{k}-{i}-" + "x" * (i % 30) for i in range(n)]
        write(tmp_path / f"part-{k}.txt", "".join(x + "\n" for x in lines))
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = readers.numbered_lines(spark, str(tmp_path), 5)
            assert [r["value"] for r in sorted(out.collect(), key=lambda r: r["line"])] == want
            assert sorted(r["line"] for r in out.collect()) == list(range(5, 5 + len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_positions_in_any_order(spark):
    import random

    from chatloom.operators import order

    rows = [(random.Random(i).randrange(50), f"k{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "a bigint, b string").repartition(7)
    out = order.ordered(df, "a", "b").collect()
    assert [(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["pos"])] == sorted(rows)
    assert order.ordered(df.limit(0), "a").count() == 0
    assert "Python" not in order.ordered(df, "a")._jdf.queryExecution().toString()
