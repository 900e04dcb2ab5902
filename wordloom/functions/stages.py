"""Text operators composed of stages, each with a beginning, a step for every element and an end, run as one function over Arrow batches.

Elements pass through the stages one by one. When they are over, the stages end in order: what a stage still held goes through the steps of the stages
after it before those end themselves. A stage's state lives within one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["Drop", "Each", "Fill", "Gather", "Squeeze", "Stage", "Until", "composed", "run_stages"]


class Stage:
    """A stage keeps elements (next returns none) or gives any number for one; stop gives what it still holds."""

    def init(self) -> None:
        """Begin a row."""

    def next(self, element: Any) -> list[Any]:
        raise NotImplementedError

    def stop(self) -> list[Any]:
        return []


class Each(Stage):
    """A function from an element to a list."""

    def __init__(self, f: Callable[[Any], list[Any]]):
        self.next = f


class Drop(Stage):
    def __init__(self, unwanted: Iterable[Any]):
        self.unwanted = frozenset(unwanted)

    def next(self, element: Any) -> list[Any]:
        return [] if element in self.unwanted else [element]


class Squeeze(Stage):
    """At most so many equal elements in a row; none is held."""

    def __init__(self, most: int = 2):
        self.most = most

    def init(self) -> None:
        self.last, self.times = None, 0

    def next(self, element: Any) -> list[Any]:
        self.times = self.times + 1 if self.times and element == self.last else 1
        self.last = element
        return [element] if self.times <= self.most else []


class Fill(Stage):
    """So many elements joined to one; the end gives those that are left."""

    def __init__(self, size: int, by: str = " "):
        self.size, self.by = size, by

    def init(self) -> None:
        self.held: list[str] = []

    def next(self, element: str) -> list[str]:
        self.held.append(element)
        return self.stop() if len(self.held) == self.size else []

    def stop(self) -> list[str]:
        out = [self.by.join(self.held)] if self.held else []
        self.held = []
        return out


class Until(Fill):
    """Elements joined up to one that matches a pattern (a sentence ends with its mark); the end gives those that are left."""

    def __init__(self, pattern: str, by: str = " "):
        super().__init__(0, by)
        self.ends = re.compile(pattern)

    def next(self, element: str) -> list[str]:
        self.held.append(element)
        return self.stop() if self.ends.search(element) else []


class Gather(Stage):
    """A function of all elements at once, such as those of wordloom.functions.exact, applied at the end."""

    def __init__(self, f: Callable[[list[Any]], list[Any]]):
        self.f = f

    def init(self) -> None:
        self.held: list[Any] = []

    def next(self, element: Any) -> list[Any]:
        self.held.append(element)
        return []

    def stop(self) -> list[Any]:
        return list(self.f(self.held))


def run_stages(stages: list[Stage], elements: Iterable[Any]) -> list[Any]:
    for stage in stages:
        stage.init()
    out: list[Any] = []

    def push(element: Any, at: int) -> None:
        """Through the stages from `at` on, depth first, so that order is kept without lists between the stages."""
        if at == len(stages):
            out.append(element)
            return
        for x in stages[at].next(element):
            push(x, at + 1)

    for element in elements:
        push(element, 0)
    for at, stage in enumerate(stages):
        for x in stage.stop():
            push(x, at + 1)
    return out


def composed(*makers: Callable[[], Stage], returns: str = "array<string>") -> Callable[[Column], Column]:
    """Stages as an operator on columns: of arrays, whose elements they get, or of texts, each of which is one element. makers are called once a batch
    (classes, or functions without arguments). A null stays null."""

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        stages = [make() for make in makers]
        return values.map(lambda v: run_stages(stages, [v] if isinstance(v, str) else v), na_action="ignore")

    return run
