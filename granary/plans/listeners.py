"""Listeners: what looks at windows and says which of them hold an event."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.core import rules

COLUMNS = ("person", "window_order", "confidence", "trigger", "priority")


class Listener(Protocol):
    """detect gives rows (person, window_order, confidence, trigger, priority) from windows and a context of each person."""

    name: str

    def detect(self, windows: DataFrame, context: DataFrame | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class RuleListener:
    """Fires where a condition holds on a window, or on it and its person's context."""

    name: str
    priority: int
    condition: str

    def detect(self, windows: DataFrame, context: DataFrame | None = None) -> DataFrame:
        df = windows if context is None else windows.join(context, "person")
        return df.filter(F.expr(self.condition)).select("person", "window_order", "confidence", F.lit(self.name).alias("trigger"), F.lit(self.priority).alias("priority"))


FIRST_GENERATION = tuple(RuleListener(*row) for row in rules.EVENTS_V0)


def heard(windows: DataFrame, listeners: Sequence[Listener] = FIRST_GENERATION, context: DataFrame | None = None) -> DataFrame:
    """What all listeners detect; names must differ."""
    names = [x.name for x in listeners]
    if len(set(names)) < len(names):
        raise ValueError("two listeners have one name")
    return reduce(DataFrame.unionByName, [x.detect(windows, context).select(*COLUMNS) for x in listeners])
