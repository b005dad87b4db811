import math

import pytest
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.operators import collate, contracts, ledger, metrics, order, vocab


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def ints(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>")


def test_adjacent_pairs(spark):
    assert value(spark, A.has_adjacent_pair(ints(0, 1, 1)))
    assert not value(spark, A.has_adjacent_pair(ints(1, 0, 1)))
    assert not value(spark, A.has_adjacent_pair(ints()))


def test_shifts_and_padding(spark):
    assert value(spark, A.shift_left(ints(1, 2, 3), F.lit(0))) == [2, 3, 0]
    assert value(spark, A.shift_right(ints(1, 2, 3), F.lit(0))) == [0, 1, 2]
    assert value(spark, A.pad(ints(1), F.lit(3), F.lit(9))) == [1, 9, 9]
    assert value(spark, A.segment_ids(ints(2, 1), F.lit(4))) == [0, 0, 1, -1]


def test_block_acceptance(spark):
    true = F.array(*[F.lit(True)] * 4)
    assert value(spark, A.accepted_length(ints(1, 2, 9, 4), ints(1, 2, 3, 4), true)) == 2
    assert value(spark, A.accepted_length(ints(1, 2, 9, 4), ints(1, 2, 3, 4), F.array(*map(F.lit, [True, True, False, True])))) == 3
    assert value(spark, A.prefix_alive(F.array(F.lit(True), F.lit(False), F.lit(True)))) == [1, 0, 0]


def test_distributions(spark):
    x = F.array(F.lit(0.0), F.lit(math.log(3.0)))
    assert value(spark, A.softmax(x)) == pytest.approx([0.25, 0.75])
    assert value(spark, A.argmax(F.array(F.lit(2.0), F.lit(5.0), F.lit(5.0)))) == 1
    assert value(spark, A.expected_acceptance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.9), F.lit(0.1)))) == pytest.approx(0.6)


def batches(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "loss double, tokens double, loss_num double, loss_den double")


POSITIONS = "pos int, correct double, denom double, acceptance double, ploss double, tokens double"


def test_evaluation_sums_before_dividing(spark):
    p = spark.createDataFrame([(0, 3.0, 4.0, None, None, 8.0), (1, 2.0, 4.0, None, None, 8.0), (0, 1.0, 1.0, None, None, 2.0), (1, 0.0, 1.0, None, None, 2.0)], POSITIONS)
    out = {r["metric"]: r["value"] for r in metrics.evaluate(batches(spark, [(2.0, 8.0), (8.0, 2.0)]), p).collect()}
    assert out["avg_acc"] == pytest.approx(0.8)
    assert out["simulated_acc_len"] == pytest.approx(1.12)
    assert out["avg_loss"] == pytest.approx(3.2)


def test_no_batches_no_metrics(spark):
    assert metrics.evaluate(batches(spark, [(1.0, 1.0)]).limit(0), spark.createDataFrame([], POSITIONS)).count() == 0


def test_large_counts_stay_exact(spark):
    n = float(2**24)
    p = spark.createDataFrame([(0, n, n, None, None, 1.0)] + [(0, 0.0, 1.0, None, None, 1.0)] * 3, POSITIONS)
    out = {r["metric"]: r["value"] for r in metrics.evaluate(batches(spark, [(1.0, 1.0)]), p).collect()}
    assert out["avg_acc"] == pytest.approx(n / (n + 3), abs=1e-12)


def test_counts_with_truncation_and_range(spark):
    rows = spark.createDataFrame([([1, 2, 2, 3], [0, 1, 1, 1]), ([2, 4, 4, 5], [1, 1, 0, 1])], "input_ids array<int>, loss_mask array<int>")
    assert {r["token"]: r["n"] for r in vocab.token_counts(rows, max_length=3, vocab_size=8).collect()} == {2: 3, 4: 1}
    with pytest.raises(Exception, match="outside target vocab"):
        vocab.token_counts(spark.createDataFrame([([0, 8], [1, 1])], rows.schema), vocab_size=8).collect()


def test_vocabulary_is_filled_up(spark):
    counts = spark.createDataFrame([(5, 3, 0), (6, 2, 0)], "token int, n bigint, first_row bigint")
    out = vocab.top_tokens(counts, 4, 8).orderBy("draft_id").collect()
    assert [r["target_id"] for r in out] == [0, 1, 5, 6]
    assert [r["draft_id"] + r["shift"] for r in out] == [0, 1, 5, 6]


def test_hysteresis(spark):
    readings = [(9, 99), (10, 20), (5, 20), (4, 40), (1, 100), (1, 50), (1, 40)]
    rows = spark.createDataFrame([(readings,)], "r array<struct<refs int, bytes int>>")
    h = rows.select(ledger.hysteresis(F.col("r"), 10, 4, 100, 40).alias("h")).first()["h"]
    assert (h["paused"], h["pauses"], h["resumes"]) == ([False, True, True, False, True, True, False], 2, 2)


def test_windows_drop_the_tail(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "pos int")
    out = {r["pos"]: (r["rank"], r["state"]) for r in order.windows(rows, 2, 1, 7).collect()}
    assert [p for p, (k, s) in sorted(out.items()) if k == 0 and s == "dispatched"] == [0, 2, 4]
    assert [p for p, (k, s) in sorted(out.items()) if s == "dropped"] == [6]


def test_few_rows_for_many_ranks(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert order.sharded(rows, 1, "k", 5).groupBy("rank").count().count() == 5
    assert order.sharded(rows.limit(0), 1, "k", 5).count() == 0


def test_schedules():
    assert order.total_steps(100, 32, 3, 4) == 2
    assert order.accumulation_plan(8, 4) == 2
    with pytest.raises(ValueError):
        order.accumulation_plan(9, 4)


def test_block_samples_need_a_pair(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 0, 1])], "input_ids array<int>, loss_mask array<int>")
    with pytest.raises(Exception, match="neighbouring"):
        collate.normalize_block_sample(rows, 8).collect()
    assert collate.normalize_sample(rows, 2).first()["loss_mask"] == [1, 0]


def test_running_best_needs_the_margin(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.55), (3, 0.58), (4, 0.7)], "step int, score double")
    assert [r["step"] for r in metrics.running_best(rows, "step", "score", 0.1).orderBy("step").collect()] == [1, 4]


def test_no_float_arrays_in_control_records(spark):
    rows = spark.createDataFrame([], "a struct<b: array<float>>, c array<int>")
    assert contracts.tensor_columns(rows.schema) == ["a.b"]


def test_schedule_records():
    assert contracts.schedule_differences({"dp": 2}, {"dp": 3, "total_steps": 0}, ["dp"]) == ["dp", "total_steps"]
