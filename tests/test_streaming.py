from chatloom.streaming import refs

REF = "sample_id string, seq bigint"


def log(spark, tmp_path, files):
    for i, ids in enumerate(files):
        spark.createDataFrame([(s, i * 100 + k) for k, s in enumerate(ids)], REF).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return refs.read_log(spark, str(tmp_path / "log"), REF, files_per_trigger=1)


def test_windows_carry_and_drop_the_tail(spark, tmp_path):
    stream = log(spark, tmp_path, [["s0", "s1", "s2"], ["s2", "s3"], ["s4", "s5", "s6"]])
    dealt, tail = refs.Dispatcher(spark, str(tmp_path / "d"), REF, ranks=2, per_rank=1).run(stream)
    ranks = {0: [], 1: []}
    for r in dealt.orderBy("window", "rank").collect():
        ranks[r["rank"]].append(r["sample_id"])
    assert ranks == {0: ["s0", "s2", "s4"], 1: ["s1", "s3", "s5"]}
    assert [r["sample_id"] for r in tail.collect()] == ["s6"]


def test_dedup(spark, tmp_path):
    stream = log(spark, tmp_path, [["a", "b"], ["a", "c"]])
    out = refs.deduplicated(stream, ["sample_id"], str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r["sample_id"] for r in out.collect()) == ["a", "b", "c"]


def test_acknowledging_twice_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2)], REF)
    for _ in range(2):
        refs.acknowledge(rows, 0, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "acked" / "*")).count() == 1
