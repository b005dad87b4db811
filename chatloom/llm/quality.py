"""Quality classification by hierarchical empirical Bayes.

Each document has evidence of its own, the log odds of a logistic regression over its text.
Its site has a level too: the mean of the documents' probabilities over the host (here the
source), shrunk toward the corpus's, and over the path (here the language within the source),
shrunk toward the host's. How strongly is estimated from how much groups differ beyond what
their sizes explain, so sparse sites hardly move a decision and large ones do. A document's
posterior log odds are its evidence plus how far its path's level lies from the corpus's.

Two targets are scored alike: good quality and toxicity. A document is kept if it is more
likely good than not and less likely toxic than not. Levels are taken without the document
itself, so that its evidence doesn't count twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import materialize

#: Labelled rows to fit on: the first by hash of doc_id. The only bound; all else is over all rows.
MAX_TRAIN = 20_000
#: Words that become features for each target, and the labelled texts a word must be in.
WORDS, SUPPORT = 150, 6
TARGETS = ("good", "toxic")
#: Site tables up to this number of rows are broadcast (some 100 MB); larger ones are joined by shuffles.
BROADCAST_SITES = 1_000_000
#: A-Z to lower case, ASCII punctuation and digits to spaces; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DENSE = 11


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split())


def dense(text: str | None) -> list[float]:
    """Shares of characters, and how much of the text is new."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * DENSE
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits, spaces, other = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum()), int(c[[9, 10, 11, 12, 13, 32]].sum()), int(c[128:].sum())
    symbols = len(data) - upper - lower - digits - spaces - other
    words = data.split()
    n = max(1, len(words))
    lines = data.split(b"\n")
    return [
        math.log1p(len(words)), upper / len(data), digits / len(data), symbols / len(data), float(c[33]) / n, float(c[124]) / n, float(c[35] + c[36] + c[37] + c[38] + c[42]) / n,
        len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / n, len(set(lines)) / len(lines), len(data) / n / 10,
    ]


class Model:
    """Logistic regressions over dense features and the presence of chosen words."""

    def __init__(self, vocabulary: list[bytes], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.index = {w: DENSE + i for i, w in enumerate(vocabulary)}
        self.mean, self.scale, self.weights = mean, scale, weights

    def evidence(self, text: str | None) -> np.ndarray:
        """Log odds of each target."""
        x = (np.array(dense(text)) - self.mean) / self.scale
        out = self.weights[:, -1] + self.weights[:, :DENSE] @ x
        hits = [i for w, i in self.index.items() if w in found] if len(self.index) < len(found := words_of(text)) else [self.index[w] for w in found if w in self.index]
        return np.clip(out + self.weights[:, hits].sum(axis=1), -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept, the last weight."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, good, toxic in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found = sorted(words_of(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([good] * len(found), pa.float64()), pa.array([toxic] * len(found), pa.float64())], ["word", "good", "toxic"])


def _describe(vocabulary: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(vocabulary)}
        for b in batches:
            x, hits = [], []
            for t in b.column(0):
                x.append(dense(t.as_py()))
                hits.append(sorted(index[w] for w in words_of(t.as_py()) if w in index))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.int32())), b.column(1), b.column(2)], ["x", "hits", "good", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MAX_TRAIN) -> Model | None:
    """Fit on at most ``most`` labelled rows; None where no label of both kinds of quality is
    there. ``labels`` has ``doc_id, quality, toxic``; of several rows the mean counts, rounded;
    null labels are left out. Of rows that repeat a doc_id the first text in order counts."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("quality")).alias("good"), F.round(F.avg("toxic")).alias("toxic"))
    some = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")  # ``some`` has at most ``most`` rows
    rows = rows.groupBy("doc_id", "good", "toxic").agg(F.min("text").alias("text"))  # and so have these
    rows = materialize(rows.select("text", "good", "toxic"), "labelled")
    total = rows.agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).first()
    if not total["n"] or total["good"] in (0, total["n"]):
        return None
    counts = rows.mapInArrow(_bag, "word binary, good double, toxic double").groupBy("word").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= SUPPORT)
    chosen: set[bytes] = set()
    for target in TARGETS:
        # the words whose presence moves the target's odds the most, by the root of a chi-square
        rate = total[target] / total["n"]
        if 0 < rate < 1:
            score = F.abs(F.col(target) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
            chosen |= {bytes(r["word"]) for r in counts.orderBy(score.desc(), "word").limit(WORDS).collect()}
    vocabulary = sorted(chosen)
    data = rows.mapInArrow(_describe(vocabulary), "x array<double>, hits array<int>, good double, toxic double").collect()  # at most ``most`` rows
    x = np.array([r["x"] for r in data])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    full = np.zeros((len(data), DENSE + len(vocabulary)))
    full[:, :DENSE] = (x - mean) / scale
    for i, r in enumerate(data):
        full[i, [DENSE + h for h in r["hits"]]] = 1
    weights = np.array([fit_logistic(full, np.array([r[t] for r in data])) for t in TARGETS])
    return Model(vocabulary, mean, scale, weights)


def _evidence(model: Model, at: int, keep: int):
    """Batches of rows whose column ``at`` is the text, to their first ``keep`` columns, the last
    two (host and path), and the evidence for each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                e = np.array([model.evidence(t.as_py()) for t in part.column(at)]).reshape(-1, len(TARGETS))
                names = [*part.schema.names[:keep], *part.schema.names[-2:], *TARGETS]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *part.columns[-2:], *[pa.array(e[:, i]) for i in range(len(TARGETS))]], names)

    return run


def _strength(groups: DataFrame, n: str, total: str, level: Column) -> float:
    """How many rows a group's own mean must outweigh: from the variance between groups beyond
    that of means of so many rows."""
    r = groups.agg(
        F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(F.col(n) * level * (1 - level)).alias("in"), F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - level, F.lit(2))).alias("out")
    ).first()
    if not r["n"]:
        return 1.0
    inside, between = r["in"] / r["n"], r["out"] / r["n"]
    spread = between - inside * r["g"] / r["n"]
    return min(1e6, max(1.0, inside / max(spread, 1e-9)))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


class Sites:
    """Sums over hosts and paths, and how strongly they are shrunk.

    ``table`` has a row for each ``host, path``: ``n, hn`` (rows of the path, of the host) and for
    each target ``<t>_sum, <t>_hsum`` (their probabilities' sums)."""

    def __init__(self, scored: DataFrame):
        """``scored`` has ``host, path`` and each target's evidence (log odds)."""
        paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(probability(F.col(t))).alias(f"{t}_sum") for t in TARGETS]), "paths")
        whole = paths.agg(F.sum("n").alias("n"), *[F.sum(f"{t}_sum").alias(t) for t in TARGETS]).first()
        hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"{t}_sum").alias(f"{t}_hsum") for t in TARGETS])
        self.level = {t: (whole[t] / whole["n"] if whole["n"] else 0.5) for t in TARGETS}
        self.host_strength = {t: _strength(hosts, "hn", f"{t}_hsum", F.lit(self.level[t])) for t in TARGETS}
        self.table = materialize(paths.join(hosts, "host"), "sites")
        self.path_strength = {t: _strength(self.table, "n", f"{t}_sum", self.host_level(t)) for t in TARGETS}

    def host_level(self, t: str, own: Column | float = 0.0, rows: int = 0) -> Column:
        """The host's level without ``rows`` rows whose probabilities sum to ``own``."""
        k = self.host_strength[t]
        return (F.greatest(F.lit(0.0), F.col(f"{t}_hsum") - own) + k * self.level[t]) / (F.col("hn") - rows + k)

    def path_level(self, t: str, host: Column, own: Column | float = 0.0, rows: int = 0) -> Column:
        k = self.path_strength[t]
        return (F.greatest(F.lit(0.0), F.col(f"{t}_sum") - own) + k * host) / (F.col("n") - rows + k)


ADDED = ["p_good", "p_toxic", "good_host", "good_path", "toxic_host", "toxic_path", "keep"]


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``p_good, p_toxic`` (posteriors), the shrunk levels of
    the row's host and path for both targets, taken without the row, and ``keep``.

    Texts are read once: what is returned of the rows is written with their evidence, so leave
    columns out that aren't needed. Null and empty texts have the evidence of a text without
    characters; null hosts and paths count as ``''``. Rows are judged one by one, so repeated
    rows get equal results. Without usable labels all rows are kept with null posteriors. An
    empty table gives no rows; columns named as the added ones are replaced, others may have
    any name.
    """
    given = [c for c in columns or docs.columns if c.lower() not in ADDED]
    named = lambda c: F.col(f"`{c}`")
    model = train(docs, labels, text, doc_id)
    if model is None:
        return docs.select(*map(named, given), *[F.lit(None).cast("double").alias(c) for c in ADDED[:-1]], F.lit(True).alias("keep"))
    # Columns go by their number, so that no name can clash.
    site = [F.coalesce(named(c).cast("string"), F.lit("")).alias(as_) for c, as_ in ((host, "host"), (path, "path"))]
    inner = docs.select(*[named(c).alias(f"r{i}") for i, c in enumerate(given)], *([] if text in given else [named(text).alias("text")]), *site)
    kinds = [f"r{i} {inner.schema[f'r{i}'].dataType.simpleString()}" for i in range(len(given))] + ["host string", "path string"] + [f"{t} double" for t in TARGETS]
    at = given.index(text) if text in given else len(given)
    scored = materialize(inner.mapInArrow(_evidence(model, at, len(given)), ", ".join(kinds)), "scored")
    sites = Sites(scored)
    out = scored.join(F.broadcast(sites.table) if sites.table.count() <= BROADCAST_SITES else sites.table, ["host", "path"])
    for t in TARGETS:
        p = probability(F.col(t))
        out = out.withColumn(f"{t}_host", sites.host_level(t, p, 1))
        out = out.withColumn(f"{t}_path", sites.path_level(t, F.col(f"{t}_host"), p, 1))
        out = out.withColumn(f"p_{t}", probability(F.col(t) + logit(F.col(f"{t}_path")) - logit(F.lit(sites.level[t]))))
    out = out.withColumn("keep", (F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5))
    return out.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(given)], *ADDED)
