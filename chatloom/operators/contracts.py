"""Checks of records against what was declared; each names the first thing wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.schemas import WIDTHS


def pretokenized_error(ids: Column, mask: Column) -> Column:
    """The first error of a pre-tokenized record, null if it is valid."""
    return F.coalesce(
        F.when(ids.isNull() | mask.isNull(), "input_ids and loss_mask are required"),
        F.when(F.size(ids) == 0, "input_ids must not be empty"),
        F.when(F.size(ids) != F.size(mask), "input_ids and loss_mask must have equal length"),
        F.when(F.exists(ids, lambda x: x.isNull() | (x < 0)), "input_ids must be integers"),
        F.when(F.exists(mask, lambda x: x.isNull() | ~x.isin(0, 1)), "loss_mask must be binary"),
    )


def unnest(c: Column) -> Column:
    """A sequence out of a list of one sequence."""
    return F.when(F.size(c) == 1, F.get(c, F.lit(0)))


def capture_error(spec: Column, shapes: Column, required: list[str], layers: list[int], hidden: int, target_width: int) -> Column:
    """The first mismatch of a capture: names missing, layers not the declared ones, auxiliary
    width not layers * hidden, or the target's last dimension."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.map_keys(shapes))
    last = lambda name: F.element_at(F.try_element_at(shapes, F.lit(name)), -1)
    return F.coalesce(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing features: "), F.array_join(missing, ","))),
        F.when(spec != F.array(*map(F.lit, layers)), F.lit("captured layers differ from the declared ones")),
        F.when(last("aux_hidden_state") != len(layers) * hidden, F.lit("auxiliary width must be layers * hidden")),
        F.when(last("target") != target_width, F.lit("target width differs")),
    )


def mixed_batches(refs: DataFrame, batch: str = "batch") -> DataFrame:
    """Batches that hold more than one strategy, schema version or target representation."""
    kinds = ["strategy", "schema_version", "target_repr"]
    return refs.groupBy(batch).agg(*[F.count_distinct(k).alias(k) for k in kinds]).filter(" OR ".join(f"{k} > 1" for k in kinds))


def tensor_columns(schema: T.StructType, path: str = "") -> list[str]:
    """Paths of columns that hold arrays of floating numbers: control records must have none."""
    out: list[str] = []

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{at}.{f.name}" if at else f.name)
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
                out.append(at)
            walk(kind.elementType, f"{at}[]")
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, f"{at}{{}}")

    walk(schema, path)
    return out


def width_of(dtype: Column) -> Column:
    """Bytes of an element by its type's name."""
    return F.create_map(*[x for k, v in WIDTHS.items() for x in (F.lit(k), F.lit(v))])[dtype]


def schedule_differences(ours: dict, theirs: dict, fields: list[str]) -> list[str]:
    """The fields in which two schedule records differ; a schedule without steps is one."""
    out = [f for f in fields if ours.get(f) != theirs.get(f)]
    return out + (["total_steps"] if theirs.get("total_steps", 0) < 1 and "total_steps" not in out else [])


def response_checks(rows: DataFrame, block: int) -> DataFrame:
    """``verdict`` of served responses from ``accept_length, reasoning, wants_reasoning``."""
    bad = F.when(F.col("accept_length") > block, "accept length above the block").when(F.col("wants_reasoning") & (F.coalesce(F.length("reasoning"), F.lit(0)) == 0), "reasoning is missing").when(~F.col("wants_reasoning") & (F.coalesce(F.length("reasoning"), F.lit(0)) > 0), "reasoning is not asked for")
    return rows.withColumn("verdict", F.coalesce(bad, F.lit("ok")))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the query on a row that doesn't meet the condition."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def option_error() -> Column:
    """The first thing wrong with the options ``max_length, min_loss_tokens, max_prompts (or null),
    cache_dir, cache_key`` of a row, null if they are fine."""
    return F.coalesce(
        F.when(F.coalesce(F.col("max_length") < 1, F.lit(True)), "max_length must be positive"),
        F.when(F.coalesce(F.col("min_loss_tokens") < 0, F.lit(True)), "min_loss_tokens must not be negative"),
        F.when(F.col("max_prompts") < 0, "max_prompts must not be negative"),
        F.when(F.col("cache_dir").isNull() != F.col("cache_key").isNull(), "cache_dir and cache_key go together"),
    )


def handshake(ours: Column, theirs: Column, fields: list[str]) -> Column:
    """The fields in which two schedule records (structs) differ, nulls being equal; a schedule
    without steps differs in ``total_steps``."""
    wrong = [F.when(~ours[f].eqNullSafe(theirs[f]), F.lit(f)) for f in fields]
    return F.array_compact(F.array(*wrong, F.when(F.coalesce(theirs["total_steps"], F.lit(0)) < 1, F.lit("total_steps"))))
