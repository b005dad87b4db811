"""Metrics as ratios of sums: numerators and denominators are added up before any division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import arrays as A


def ratio(num: Column, den: Column, floor: float) -> Column:
    return F.sum(num.cast("double")) / F.greatest(F.sum(den.cast("double")), F.lit(float(floor)))


def ratio_metrics(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``metric, value`` from long rows (metric, pos, num, den): metrics of several positions are
    named ``metric_pos``."""
    keys = keys or []
    sums = rows.groupBy(*keys, "metric", "pos").agg(ratio(F.col("num"), F.col("den"), 1e-12).alias("value"))
    widths = sums.groupBy(*keys, "metric").agg(F.count("*").alias("width"))
    name = F.when(F.col("width") == 1, F.col("metric")).otherwise(F.concat_ws("_", "metric", F.col("pos").cast("string")))
    return sums.join(widths, [*keys, "metric"]).select(*keys, name.alias("metric"), "value")


def position_metrics(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per position ``acc, ploss, acceptance_rate``, from ``pos, correct, denom, loss, loss_denom,
    acceptance``; losses and acceptance weigh by loss_denom."""
    keys = keys or []
    w = F.col("loss_denom").cast("double")
    return rows.groupBy(*keys, "pos").agg(
        ratio(F.col("correct"), F.col("denom"), 1e-6).alias("acc"),
        ratio(F.col("loss") * w, w, 1e-6).alias("ploss"),
        ratio(F.col("acceptance") * w, w, 1e-6).alias("acceptance_rate"),
        F.sum("correct").alias("correct"),
        F.sum("denom").alias("denom"),
    )


def training_metrics(rows: DataFrame, decay: float, keys: list[str] | None = None) -> DataFrame:
    """One row: overall ``acc``, ``loss`` = sum of decay**pos * ploss, mean ``acceptance_rate``."""
    keys = keys or []
    return position_metrics(rows, keys).groupBy(*keys).agg(
        (F.sum("correct") / F.greatest(F.sum("denom"), F.lit(1e-6))).alias("acc"),
        F.sum(F.pow(F.lit(float(decay)), F.col("pos")) * F.col("ploss")).alias("loss"),
        F.avg("acceptance_rate").alias("acceptance_rate"),
    )


def token_weight(loss_denoms: Column, loss_mask: Column) -> Column:
    """A batch's weight: its loss counts, else its supervised tokens, else 1."""
    return F.coalesce(F.when(F.size(loss_denoms) > 0, A.total(loss_denoms)), F.when(loss_mask.isNotNull(), A.total(loss_mask)), F.lit(1.0))


def evaluate(batches: DataFrame, positions: DataFrame) -> DataFrame:
    """``metric, value`` of an evaluation; no rows without batches.

    ``batches`` has one row per batch: ``loss, tokens`` (loss_num and loss_den, where not null,
    instead). ``positions`` has one per batch and position: ``pos, correct, denom, acceptance,
    ploss, tokens``. Batch sizes don't matter: everything is summed before it is divided."""
    num = F.coalesce("loss_num", F.col("loss") * F.col("tokens"))
    loss = batches.agg(F.sum(num.cast("double")).alias("n"), F.sum(F.coalesce("loss_den", F.col("tokens")).cast("double")).alias("d"), F.count("*").alias("batches"))
    loss = loss.filter("batches > 0").select(F.lit("avg_loss").alias("metric"), (F.col("n") / F.greatest("d", F.lit(1.0))).alias("value"))
    per = positions.groupBy("pos").agg(
        (F.sum(F.col("correct").cast("double")) / F.greatest(F.sum(F.col("denom").cast("double")), F.lit(1.0))).alias("acc"),
        (F.sum(F.col("acceptance") * F.col("tokens")) / F.sum(F.when(F.col("acceptance").isNotNull(), F.col("tokens")))).alias("ar"),
        (F.sum(F.col("ploss") * F.col("tokens")) / F.sum(F.when(F.col("ploss").isNotNull(), F.col("tokens")))).alias("pl"),
    )
    named = per.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{n}_"), F.col("pos").cast("string")).alias("metric"), F.col(c).alias("value")) for n, c in (("per_position_acc", "acc"), ("acceptance_rate", "ar"), ("ploss", "pl"))])).alias("x")).select("x.*").filter("value IS NOT NULL")
    accs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "acc"))), lambda x: x["acc"])  # a value per position
    whole = per.agg(accs.alias("a")).filter(F.size("a") > 0).select(F.explode(F.array(
        F.struct(F.lit("avg_acc").alias("metric"), F.get("a", F.lit(0)).alias("value")),
        F.struct(F.lit("simulated_acc_len").alias("metric"), A.simulated_length(F.col("a")).alias("value")),
    )).alias("x")).select("x.*")
    return loss.unionByName(whole).unionByName(named)


def throughput(rows: DataFrame, samples: str, seconds: str, steps: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(samples) / F.sum(seconds)).alias("samples_per_second"), (F.sum(seconds) / F.sum(steps)).alias("seconds_per_step"))


def accept_length(rows: DataFrame, tokens: str, verified: str, seconds: Column, keys: list[str] | None = None) -> DataFrame:
    """``output_tokens, output_throughput, accept_length`` (1.0 where nothing was verified)."""
    t, v = F.sum(tokens), F.coalesce(F.sum(verified), F.lit(0))
    out = rows.groupBy(*(keys or [])).agg(t.alias("output_tokens"), v.alias("verified"), F.max(seconds).alias("latency"), F.count("*").alias("num_questions"))
    speed = F.when(F.col("latency") > 0, F.col("output_tokens") / F.col("latency")).otherwise(0.0)
    length = F.when(F.col("verified") == 0, 1.0).otherwise(F.col("output_tokens") / F.col("verified"))
    return out.withColumns({"output_throughput": speed, "accept_length": length}).drop("verified")


def load_test(rows: DataFrame) -> DataFrame:
    """Totals of a load test from ``completion_tokens, verify_ct, accept_length`` per request."""
    return rows.agg(F.count("*").alias("samples"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("output_tokens"), F.avg("accept_length").alias("average_acceptance_length"), F.nullif(F.coalesce(F.sum("verify_ct"), F.lit(0)), F.lit(0)).alias("spec_verify_count"))


def label_accuracy(pred: Column, label: Column) -> Column:
    """Over all rows: matches (null equals null) by labels."""
    return F.avg(pred.eqNullSafe(label).cast("double"))


def numeric_match(pred: Column, label: Column, tolerance: float = 1e-6) -> Column:
    """Equal as stripped lower-case text, else as numbers within the tolerance."""
    p, q = F.lower(F.trim(pred)), F.lower(F.trim(label))
    return F.coalesce((p == q) | (F.abs(p.try_cast("double") - q.try_cast("double")) < tolerance), F.lit(False))


def integer_match(pred: Column, label: Column) -> Column:
    p, q = F.trim(pred), F.trim(label)
    return F.coalesce((p == q) | (p.try_cast("bigint") == q.try_cast("bigint")), F.lit(False))


def labelled_accuracy(match: Column, label: Column) -> Column:
    """Matches among rows with a label by their number; null if there is none."""
    return F.sum(F.when(label.isNotNull(), match.cast("double"))) / F.nullif(F.count(label), F.lit(0))


def predicted_accuracy(match: Column, pred: Column) -> Column:
    """Matches among rows with a prediction by their number; 0 if there is none."""
    return F.coalesce(F.sum(F.when(pred.isNotNull(), match.cast("double"))) / F.nullif(F.count(pred), F.lit(0)), F.lit(0.0))


def pass_rate(passed: Column) -> Column:
    return F.coalesce(F.avg(passed.cast("double")), F.lit(0.0))


def speedup(value: Column, base: Column) -> Column:
    """The ratio to two decimals; null where either is null or 0."""
    return F.round(F.nullif(value, F.lit(0.0)) / F.nullif(base, F.lit(0.0)), 2)


def speedup_class(value: Column, base: Column) -> Column:
    r = F.nullif(value, F.lit(0.0)) / F.nullif(base, F.lit(0.0))
    return F.when(r.isNull(), "").when(r >= 2.0, "excellent").when(r >= 1.5, "good").when(r >= 1.1, "moderate").otherwise("neutral")


def with_baseline(results: DataFrame, keys: list[str], name: str, baseline: str, value: str) -> DataFrame:
    """Each result beside its group's baseline: ``base`` and ``speedup``."""
    base = results.filter(F.col(name) == baseline).groupBy(*keys).agg(F.max(value).alias("base"))
    return results.filter(F.col(name) != baseline).join(base, keys, "left").withColumn("speedup", speedup(F.col(value), F.col("base")))


def running_best(rows: DataFrame, order: str, score: str, min_delta: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Rows that improved on the best by more than ``min_delta``. The best so far is a fold: a
    better score within min_delta doesn't move it. Folded per key over its scores in order."""
    keys = keys or []
    items = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("s"))  # a run's evaluations are few
    start = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast(f"array<struct<{order}:{rows.schema[order].dataType.simpleString()},{score}:double>>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        better = a["best"].isNull() | (x[score].cast("double") > a["best"] + min_delta)
        row = F.struct(x[order].alias(order), x[score].cast("double").alias(score))
        return F.struct(F.when(better, x[score].cast("double")).otherwise(a["best"]).alias("best"), F.when(better, F.concat(a["kept"], F.array(row))).otherwise(a["kept"]).alias("kept"))

    return items.select(*keys, F.explode(F.aggregate("s", start, step)["kept"]).alias("x")).select(*keys, "x.*")


def masked_mean(value: Column, mask: Column, eps: float = 1e-6) -> Column:
    return F.sum(value * mask) / F.greatest(F.sum(mask), F.lit(eps))


def context_words(n: Column) -> list[Column]:
    return [F.min(n).alias("min_words"), F.max(n).alias("max_words"), F.avg(n).alias("avg_words")]


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The union over ranks: the first row of each key in the order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def block_terms(rows: DataFrame, gamma: float, keys: list[str]) -> DataFrame:
    """Block losses and accuracies from ``offset, loss, correct, valid``, decayed by offset."""
    w = F.when(F.col("valid"), A.decay_weight(F.col("offset"), gamma)).otherwise(0.0)
    v = F.col("valid").cast("double")
    return rows.groupBy(*keys).agg((F.sum(F.col("loss") * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("loss"), (F.sum(F.col("correct").cast("double") * v) / F.greatest(F.sum(v), F.lit(1e-6))).alias("acc"), F.sum(v).alias("valid"))


def depth_metrics(rows: DataFrame) -> DataFrame:
    """Per depth ``correct, total, acc`` over rows whose target is in the vocabulary."""
    ok = F.col("in_vocab")
    return rows.groupBy("depth").agg(F.count_if(ok & F.col("correct")).alias("correct"), F.count_if(ok).alias("total")).withColumn("acc", F.col("correct") / F.greatest("total", F.lit(1)))


def confidence_terms(confidence: Column, accepted: Column) -> dict[str, Column]:
    """Means over positions: cross-entropy of the confidence, its absolute error, and how often it
    falls on the right side of one half."""
    c = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), confidence))
    bce = -(accepted * F.ln(c) + (1 - accepted) * F.ln(1 - c))
    return {"bce": F.avg(bce), "abs_error": F.avg(F.abs(confidence - accepted)), "agreement": F.avg(((confidence >= 0.5) == (accepted == 1)).cast("double"))}


def mapped_accuracy(rows: DataFrame, pred: str, d2t: list[int], target: str, mask: str, keys: list[str]) -> DataFrame:
    """``correct, denom, accuracy`` of draft ids against target ids: ``d2t`` has for each draft id
    what must be added to it. Only rows with mask 1 count; the denominator is 1e-6 at least."""
    offsets = F.array(*map(F.lit, d2t))
    hit = (F.col(pred) + F.get(offsets, F.col(pred).cast("int")) == F.col(target)) & (F.col(mask) == 1)
    out = rows.groupBy(*keys).agg(F.count_if(hit).cast("double").alias("correct"), F.greatest(F.sum(mask).cast("double"), F.lit(1e-6)).alias("denom"))
    return out.withColumn("accuracy", F.col("correct") / F.col("denom"))
