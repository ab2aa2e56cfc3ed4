"""The bins of granary.core.rules as functions from a column name to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.core import rules
from granary.core.numbers import py_round

NAMES = (
    "ratio_bin", "legacy_ratio_bin", "count_level", "count_bin", "activity_ratio_bin", "lighting", "blur", "clip_duration", "duration_minutes", "coarse_minutes", "continuous_duration", "size_mb", "face_size", "eye_openness",
    "audit_count", "audit_seconds", "audit_ratio", "audit_bpm", "share_range", "episode_duration", "share_level", "activity_level", "point_level", "phase_level",
)


def bin_of(name: str, column: str) -> Column:
    """The named bin of a column."""
    if name not in NAMES:
        raise KeyError(f"unknown bin {name}; known: {', '.join(NAMES)}")
    return F.expr(getattr(rules, name)(f"`{column}`"))


def rounded(column: str, digits: int) -> Column:
    """A column rounded as Python's round does."""
    return F.expr(py_round(f"`{column}`", digits))
