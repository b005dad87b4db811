"""Ledgers: what is committed, what is acknowledged, and what a restart makes of both."""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(batch: DataFrame, ledger: DataFrame, key: str = "sample_id", order: str = "seq") -> DataFrame:
    """Column ``is_fresh``: not in the ledger, and the first of its key in the batch."""
    known = ledger.select(key).distinct().withColumn("__known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return batch.withColumn("__first", first).join(known, key, "left").withColumn("is_fresh", F.col("__first") & F.col("__known").isNull()).drop("__first", "__known")


def reconcile(committed: DataFrame, acked: DataFrame, durable: Column, key: str = "sample_id") -> DataFrame:
    """Column ``fate``: ``released`` where a durable row is acknowledged, else ``requeued``."""
    done = acked.select(key).distinct().withColumn("__acked", F.lit(True))
    return committed.join(done, key, "left").withColumn("fate", F.when(F.col("__acked").isNotNull() & durable, "released").otherwise("requeued")).drop("__acked")


def match_responses(tasks: DataFrame, responses: DataFrame, key: str = "sample_id") -> DataFrame:
    """Tasks with their response. ``outcome``: ok, missing (terminal), or duplicate (an error)."""
    one = responses.groupBy(key).agg(F.count("*").alias("__n"), F.min(F.struct(*[c for c in responses.columns if c != key])).alias("response"))
    out = tasks.join(one, key, "left")
    return out.withColumn("outcome", F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "duplicate").otherwise("ok")).drop("__n")


def zip_positions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal position; a position that only one side has is an error."""
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), keys, "full")
    bad = F.col("__a").isNull() | F.col("__b").isNull()
    return both.filter(F.when(bad, F.raise_error(F.lit("the sides differ in number")).cast("boolean")).otherwise(F.lit(True))).drop("__a", "__b")


def capture_outcome(rows: DataFrame) -> DataFrame:
    """``outcome, retryable, reason`` of capture results from ``result_id, task_id, server_error,
    captured_len, prompt_len``: the first rule that applies."""
    found, same = F.col("result_id").isNotNull(), F.col("result_id") == F.col("task_id")
    rules = [
        (~found, "failed", False, F.lit("missing result")),
        (F.col("server_error").isNotNull(), "failed", True, F.col("server_error")),
        (~same, "raise", False, F.lit("result belongs to another task")),
        (F.col("captured_len") != F.col("prompt_len"), "aborted", False, F.lit("captured length differs from the prompt's")),
    ]
    out = F.struct(F.lit("ok").alias("outcome"), F.lit(False).alias("retryable"), F.lit(None).cast("string").alias("reason"))
    for cond, state, retry, why in reversed(rules):
        out = F.when(cond, F.struct(F.lit(state).alias("outcome"), F.lit(retry).alias("retryable"), why.alias("reason"))).otherwise(out)
    return rows.withColumn("__o", out).select(*rows.columns, "__o.*")


def lifecycle(events: DataFrame, max_attempts: int, key: str = "task_id", order: str = "seq") -> DataFrame:
    """State of each task from its events (``ingest, lease, complete, fail``): ``attempts`` counts
    failures, and the last event decides unless the attempts are spent."""
    out = events.groupBy(key).agg(F.count_if(F.col("event") == "fail").alias("attempts"), F.max_by("event", order).alias("last"))
    state = F.when(F.col("last") == "complete", "completed").when(F.col("attempts") >= max_attempts, "failed").when(F.col("last") == "lease", "leased").otherwise("pending")
    return out.withColumn("state", state).drop("last")


def latest_generation(handles: DataFrame, key: str = "sample_id") -> DataFrame:
    """The newest generation of each sample."""
    return handles.groupBy(key).agg(F.max("generation").alias("generation"), F.max_by("lease_token", "generation").alias("lease_token"))


def hysteresis(readings: Column, high_refs: int, low_refs: int, high_bytes: int, low_bytes: int) -> Column:
    """Fold of readings (refs, bytes) in order to ``paused`` flags and the numbers of ``pauses`` and
    ``resumes``: pauses at either high mark, resumes when both are at their low ones."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<boolean>").alias("flags"), F.lit(0).alias("pauses"), F.lit(0).alias("resumes"))

    def step(s: Column, r: Column) -> Column:
        high = (r["refs"] >= high_refs) | (r["bytes"] >= high_bytes)
        low = (r["refs"] <= low_refs) & (r["bytes"] <= low_bytes)
        on = F.when(s["on"], ~low).otherwise(high)
        return F.struct(on.alias("on"), F.concat(s["flags"], F.array(on)).alias("flags"), (s["pauses"] + F.when(~s["on"] & on, 1).otherwise(0)).alias("pauses"), (s["resumes"] + F.when(s["on"] & ~on, 1).otherwise(0)).alias("resumes"))

    return F.aggregate(readings, start, step, lambda s: F.struct(s["flags"].alias("paused"), s["pauses"].alias("pauses"), s["resumes"].alias("resumes")))


def outstanding_bytes(rows: DataFrame, key: str, order: str, size: str, consumed: Column) -> DataFrame:
    """Per key: bytes published, and those of the rows behind the ``consumed`` first ones."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(order))
    at = rows.withColumn("__r", r).withColumn("__left", F.when(F.col("__r") > consumed, F.col(size)))
    return at.groupBy(key).agg(F.sum(size).alias("published"), F.coalesce(F.sum("__left"), F.lit(0)).alias("outstanding"))


def advance(targets: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Consumed targets in order: ``accepted`` unless one lies below an earlier one (a conflict);
    equal ones are idempotent."""
    best = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return targets.withColumn("accepted", F.coalesce(F.col(value) >= best, F.lit(True)))


def anti_resume(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output: by id, so the order of outputs doesn't matter."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def lease_queue(events: DataFrame, queue: str = "queue", key: str = "sample_id", order: str = "seq") -> DataFrame:
    """Each queue's samples after its events in order: ``state`` is ``pending`` (with its ``place``
    from 0), ``leased``, ``acked`` or ``failed``.

    ``events`` has ``event`` (``put, get, ack, retry, fail``) and for ``get`` its ``count``. A put
    of a sample that is pending or leased changes nothing, a get leases the first pending ones, an
    ack ends a lease, a retry puts the sample at the tail, a fail drops it. A queue's log is
    folded by one task; its rows are the events of one queue."""
    kind = events.schema[key].dataType.simpleString()
    at = events.schema[queue].dataType.simpleString()

    def fold(keys: tuple, log: pd.DataFrame) -> pd.DataFrame:
        pending: dict = {}  # in the order of the queue
        other: dict = {}
        for event, sample, count in log.sort_values(order)[["event", key, "count"]].itertuples(index=False):
            if event == "put" and sample not in pending and other.get(sample) != "leased":
                other.pop(sample, None)
                pending[sample] = True
            elif event == "get":
                for first in list(islice(pending, int(count))):
                    del pending[first]
                    other[first] = "leased"
            elif event == "ack" and other.get(sample) == "leased":
                other[sample] = "acked"
            elif event in ("retry", "fail"):
                if event == "retry":
                    other.pop(sample, None)
                    pending[sample] = True
                elif sample in other:
                    other[sample] = "failed"
        rows = [(keys[0], s, "pending", i) for i, s in enumerate(pending)] + [(keys[0], s, state, None) for s, state in other.items()]
        return pd.DataFrame(rows, columns=[queue, key, "state", "place"]).astype({"place": "Int64"})

    return events.groupBy(queue).applyInPandas(fold, f"{queue} {at}, {key} {kind}, state string, place bigint")
