"""Named parts that others add: scorers of benchmarks, algorithms, input adapters, drafts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame

Part = TypeVar("Part")


class Registry(Generic[Part]):
    """Parts by name. A name is taken once; an unknown one is an error that lists the known."""

    def __init__(self, kind: str):
        self.kind, self.parts = kind, dict[str, Part]()

    def add(self, name: str, part: Part | None = None):
        """Register ``part``, or what is decorated."""

        def put(part: Part) -> Part:
            if self.parts.setdefault(name, part) is not part:
                raise ValueError(f"{self.kind} {name} is registered already")
            return part

        return put if part is None else put(part)

    def get(self, name: str) -> Part:
        if name not in self.parts:
            raise KeyError(f"unknown {self.kind} {name}; known: {', '.join(sorted(self.parts))}")
        return self.parts[name]

    def names(self) -> list[str]:
        return sorted(self.parts)


@dataclass(frozen=True)
class Algorithm:
    """What a training algorithm asks of its feature rows, and how they are normalized."""

    required: tuple[str, ...]
    normalize: Callable[[DataFrame, int], DataFrame]
    draft: str


#: Rows with predictions and labels to one row of metrics.
SCORERS: Registry[Callable[[DataFrame], DataFrame]] = Registry("benchmark")
ALGORITHMS: Registry[Algorithm] = Registry("algorithm")
#: Prompt rows to the body of a request.
ADAPTERS: Registry[Callable[[Column], Column]] = Registry("adapter")
#: Names of draft models to their configuration.
DRAFTS: Registry[dict] = Registry("draft model")


def prepared(algorithm: str, rows: DataFrame, max_length: int) -> DataFrame:
    """Rows as an algorithm takes them; a missing feature is an error."""
    a = ALGORITHMS.get(algorithm)
    missing = [c for c in a.required if c not in rows.columns]
    if missing:
        raise ValueError(f"{algorithm} needs {', '.join(missing)}")
    DRAFTS.get(a.draft)
    return a.normalize(rows, max_length)
