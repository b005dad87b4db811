"""Arrays of numbers: masks, shifts, folds, distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mask_count(mask: Column) -> Column:
    """Supervised tokens."""
    return F.aggregate(mask, F.lit(0), lambda s, x: s + x)


def has_adjacent_pair(mask: Column) -> Column:
    """Whether two neighbours are both 1. A fold, so that the array is evaluated once."""
    start = F.struct(F.lit(0).alias("last"), F.lit(False).alias("found"))

    def step(s: Column, x: Column) -> Column:
        one = F.when(x == 1, 1).otherwise(0)
        return F.struct(one.alias("last"), (s["found"] | ((s["last"] == 1) & (one == 1))).alias("found"))

    return F.coalesce(F.aggregate(mask, start, step, lambda s: s["found"]), F.lit(False))


def head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def pad(a: Column, n: Column, fill: Column) -> Column:
    """``a`` and ``fill`` up to ``n`` elements."""
    return F.concat(a, F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def shift_left(a: Column, fill: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.slice(a, 2, F.size(a)), F.array(fill))).otherwise(a)


def shift_right(a: Column, fill: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.array(fill), F.slice(a, 1, F.size(a) - 1))).otherwise(a)


def zero_last(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.lit(0)))).otherwise(a)


def gather(a: Column, at: Column) -> Column:
    """Elements by 0-based index; null outside."""
    return F.transform(at, lambda i: F.get(a, i))


def segment_ids(lengths: Column, n: Column) -> Column:
    """The number of the segment of each position; -1 behind the last."""
    ids = F.flatten(F.transform(lengths, lambda k, i: F.array_repeat(i, k)))
    return pad(ids, n, F.lit(-1))


def prefix_alive(ok: Column) -> Column:
    """1 while all flags so far hold."""
    state = F.struct(F.array().cast("array<int>").alias("out"), F.lit(1).alias("on"))

    def step(s: Column, x: Column) -> Column:
        on = F.when(x, s["on"]).otherwise(0)
        return F.struct(F.concat(s["out"], F.array(on)).alias("out"), on.alias("on"))

    return F.aggregate(ok, state, step, lambda s: s["out"])


def accepted_length(predicted: Column, target: Column, valid: Column) -> Column:
    """Valid positions before the first valid one that is wrong."""
    rows = F.zip_with(F.arrays_zip(predicted.alias("p"), target.alias("t")), valid, lambda a, v: F.struct((a["p"] == a["t"]).alias("ok"), v.alias("v")))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(s: Column, x: Column) -> Column:
        on = s["on"] & (x["ok"] | ~x["v"])
        return F.struct((s["n"] + F.when(on & x["v"], 1).otherwise(0)).alias("n"), on.alias("on"))

    return F.aggregate(rows, start, step, lambda s: s["n"])


def simulated_length(accuracies: Column) -> Column:
    """a0 + a0*a1 + ...: tokens accepted on average."""
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("t"))
    return F.aggregate(accuracies, start, lambda s, a: F.struct((s["c"] * a).alias("c"), (s["t"] + s["c"] * a).alias("t")), lambda s: s["t"])


def decay_weight(position: Column, gamma: float, kind: str = "anchored") -> Column:
    """exp(-max(k-1, 0)/gamma) (``anchored``), or exp(-k/gamma) (``plain``)."""
    k = F.greatest(position - 1, F.lit(0)) if kind == "anchored" else position
    return F.exp(-k / F.lit(float(gamma)))


def discounted(values: Column, decay: float) -> Column:
    """Sum of decay**i * value_i."""
    return F.aggregate(F.transform(values, lambda v, i: v * F.pow(F.lit(float(decay)), i)), F.lit(0.0), lambda s, x: s + x)


def linear_schedule(step: Column, steps: Column, start: float, ratio: float) -> Column:
    """From ``start`` down to 0 over the first ``ratio`` of the steps."""
    over = F.greatest(steps * F.lit(ratio), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.lit(float(start)) * (1 - F.least(step / over, F.lit(1.0))))


def argmax(a: Column) -> Column:
    """The lowest 0-based index of the largest element; null for an empty array."""
    return F.nullif(F.array_position(a, F.array_max(a)) - 1, F.lit(-1))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once for each use in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def logsumexp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: top + F.ln(total(F.transform(a, lambda x: F.exp(x - top)))))


def softmax(a: Column) -> Column:
    return let(logsumexp(a), lambda all_: F.transform(a, lambda x: F.exp(x - all_)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-sum of target * log softmax(logits)."""
    return let(logsumexp(logits), lambda all_: -total(F.zip_with(logits, target, lambda x, p: p * (x - all_))))


def expected_acceptance(p: Column, q: Column) -> Column:
    """Sum of the elementwise least."""
    return total(F.zip_with(p, q, lambda a, b: F.least(a, b)))


def log_acceptance(a: Column) -> Column:
    return F.when(a > 0, F.ln(a)).otherwise(0.0)


def restrict(a: Column, keep: Column) -> Column:
    """The elements where ``keep`` is true: a distribution over a smaller vocabulary."""
    both = F.arrays_zip(a.alias("x"), keep.alias("k"))
    return F.transform(F.filter(both, lambda z: z["k"]), lambda z: z["x"])


def prefix_products(a: Column) -> Column:
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(1.0).alias("c"))
    return F.aggregate(a, start, lambda s, x: F.struct(F.concat(s["out"], F.array(s["c"] * x)).alias("out"), (s["c"] * x).alias("c")), lambda s: s["out"])


def suffix_sums(a: Column) -> Column:
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("c"))
    return F.reverse(F.aggregate(F.reverse(a), start, lambda s, x: F.struct(F.concat(s["out"], F.array(s["c"] + x)).alias("out"), (s["c"] + x).alias("c")), lambda s: s["out"]))


def pace_weights(confidence: Column, smooth: float = 0.0) -> Column:
    """Weights of a block's positions: suffix sums of the prefix products of the smoothed
    confidences, by the first."""
    p = prefix_products(F.transform(confidence, lambda c: c * (1 - smooth) + smooth))
    return let(suffix_sums(p), lambda s: F.transform(s, lambda x: x / F.greatest(F.get(s, F.lit(0)), F.lit(1e-12))))


def shared_prefix(a: Column, b: Column) -> Column:
    """Elements that two arrays begin with alike."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    cut = F.array_position(same, False)
    return F.when(cut > 0, cut - 1).otherwise(F.least(F.size(a), F.size(b)).cast("bigint"))


def bytes_of(shape: Column, width: Column) -> Column:
    """Bytes of a dense array."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda s, n: s * n) * width
