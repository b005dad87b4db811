"""Truncation, padding, normalization and expansion of token arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import arrays as A


def pad_batch(rows: DataFrame, columns: dict[str, float], batch: str = "batch", multiple: int = 1) -> DataFrame:
    """Arrays filled up to the longest of their batch, rounded up to ``multiple``; ``columns`` maps
    each to its fill."""
    longest = F.max(F.greatest(*[F.size(c) for c in columns], *([F.lit(0)] if len(columns) == 1 else []))).over(Window.partitionBy(batch))
    rows = rows.withColumn("__n", (F.ceil(longest / multiple) * multiple).cast("int"))
    return rows.withColumns({c: A.pad(F.col(c), F.col("__n"), F.lit(v).cast(rows.schema[c].dataType.elementType)) for c, v in columns.items()}).drop("__n")


def concat_features(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key with its rows' arrays joined in order."""
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("p"))
    return parts.select(key, *[F.flatten(F.col(f"p.{c}")).alias(c) for c in columns])


def normalize_sample(rows: DataFrame, max_length: int, zero_last: bool = True) -> DataFrame:
    """``input_ids`` and ``loss_mask`` cut to ``max_length``, the last mask bit cleared, and an
    ``attention_mask`` of ones."""
    ids, mask = A.head(F.col("input_ids"), max_length), A.head(F.col("loss_mask"), max_length)
    mask = A.zero_last(mask) if zero_last else mask
    return rows.withColumns({"input_ids": ids, "loss_mask": mask, "attention_mask": F.array_repeat(F.lit(1), F.size(ids))})


def normalize_block_sample(rows: DataFrame, max_length: int) -> DataFrame:
    """As above without clearing; rows of unequal lengths or without two neighbouring supervised
    tokens are an error."""
    rows = normalize_sample(rows, max_length, zero_last=False)
    bad = F.when(F.size("input_ids") != F.size("loss_mask"), "input_ids and loss_mask differ in length").when(~A.has_adjacent_pair(F.col("loss_mask")), "no two neighbouring supervised tokens")
    return rows.withColumn("input_ids", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("input_ids")))


def sequence_slices(rows: DataFrame, ids: str, ranks: int, overlap: int = 0, fill: int = 0) -> DataFrame:
    """One row per rank with its slice of the padded array, ``overlap`` elements of the next one's,
    and ``position_ids``."""
    n = F.ceil(F.size(ids) / ranks)
    padded = A.pad(F.col(ids), (n * ranks + overlap).cast("int"), F.lit(fill))
    at = rows.withColumns({"__all": padded, "__n": n.cast("int")}).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    part = F.slice("__all", F.col("rank") * F.col("__n") + 1, F.col("__n") + overlap)
    at = at.withColumns({ids: part, "position_ids": F.transform(part, lambda x, i: F.col("rank") * F.col("__n") + i)})
    return at.drop("__all", "__n")


def anchor_blocks(rows: DataFrame, block: int, ids: str = "input_ids", mask: str = "loss_mask", anchors: str = "anchors") -> DataFrame:
    """One row per anchor and offset: ``anchor, offset, label, valid``. Valid within the sequence
    where the mask is 1; the label outside is 0."""
    rest = [c for c in rows.columns if c not in (ids, mask, anchors)]
    at = rows.select(*rest, ids, mask, F.explode(anchors).alias("anchor")).select(*rest, ids, mask, "anchor", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("offset"))
    pos = F.col("anchor") + F.col("offset")
    return at.select(*rest, "anchor", "offset", F.coalesce(F.get(ids, pos), F.lit(0)).alias("label"), (F.coalesce(F.get(mask, pos), F.lit(0)) == 1).alias("valid"))


def unroll(rows: DataFrame, length: int, ids: str = "input_ids", fill: int = 0) -> DataFrame:
    """One row per step, with the array shifted left by the step."""
    at = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    n = F.size(ids)
    return at.withColumn(ids, A.pad(F.slice(ids, F.col("step") + 1, n), n, F.lit(fill)))


def flatten_lists(rows: DataFrame, column: str) -> DataFrame:
    """Lists of lists in ``column`` as one list, however deep; null lists within are left out."""
    kind = rows.schema[column].dataType
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        rows = rows.withColumn(column, F.flatten(F.filter(column, lambda x: x.isNotNull())))
        kind = kind.elementType
    return rows


def file_group(index: Column, per: int = 2000) -> Column:
    """The folder of a feature file: ``rows_{first}-{first + per}``."""
    first = F.floor(index / per) * per
    return F.concat(F.lit("rows_"), first.cast("string"), F.lit("-"), (first + per).cast("string"))


def block_mask(queries: DataFrame, keys: DataFrame, window: int | None = None) -> DataFrame:
    """Pairs that may attend: a query of a block (``doc, anchor, pos``) sees context positions of
    its document before its anchor (within ``window``) and positions of its own block. ``keys``
    has ``doc, anchor (null for context), pos``; an equi-join on the document."""
    q, k = queries.alias("q"), keys.alias("k")
    context = F.col("k.anchor").isNull() & (F.col("k.pos") < F.col("q.anchor"))
    if window is not None:
        context = context & (F.col("k.pos") >= F.col("q.anchor") - window)
    own = F.col("k.anchor") == F.col("q.anchor")
    return q.join(k, (F.col("q.doc") == F.col("k.doc")) & (context | F.coalesce(own, F.lit(False)))).select(F.col("q.doc").alias("doc"), F.col("q.anchor").alias("anchor"), F.col("q.pos").alias("q_pos"), F.col("k.pos").alias("k_pos"), own.alias("same_block"))


def ceil_to(n: int, multiple: int) -> int:
    return math.ceil(n / multiple) * multiple
