"""Named evidence plans from an event table to one row for each person."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import package, temporal, windows
from granary.sources.events import active_frames, legacy_frames

Extractor = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """Register a plan under a name of its own."""

    def register(make: Extractor) -> Extractor:
        if name in REGISTRY:
            raise ValueError(f"extractor {name} is registered twice")
        REGISTRY[name] = make
        return make

    return register


def available() -> list[str]:
    return sorted(REGISTRY)


def build(name: str) -> Extractor:
    if name not in REGISTRY:
        raise KeyError(f"unknown extractor {name}; known: {', '.join(available())}")
    return REGISTRY[name]


@extractor("manifest_only")
def manifest_only(events: DataFrame) -> DataFrame:
    """What there is of each person, without a look at frames."""
    return events.groupBy(F.col("user_id").alias("person")).agg(F.count(F.lit(1)).alias("n_frames"), F.lit("metadata_only").alias("status"))


@extractor("windows_v1")
def windows_v1(events: DataFrame) -> DataFrame:
    w = windows.window_summary(active_frames(events))
    return windows.session_summary(w).join(windows.interaction_summary(w, 1), "person")


@extractor("windows_v2")
def windows_v2(events: DataFrame, salt: str = "granary") -> DataFrame:
    """Calibrated windows, states, events and facts as nested evidence records.

    Five summaries read the windows; as their plans begin alike, the shuffles below them are done once.
    """
    w = windows.calibrated(windows.window_summary(active_frames(events)))
    states = windows.window_states(w)
    summary, picked = windows.temporal_summary(states), windows.events_v1(w)
    facts = package.fact_lists(summary, windows.episode_detectors(summary), picked)
    return package.evidence_records(windows.session_summary(w), windows.interaction_summary(w, 2), summary, facts, picked, salt=salt)


@extractor("temporal")
def temporal_summary(events: DataFrame) -> DataFrame:
    return temporal.sequence_summary(legacy_frames(events))


@extractor("trace")
def trace(events: DataFrame) -> DataFrame:
    return temporal.trace_summary(legacy_frames(events))
