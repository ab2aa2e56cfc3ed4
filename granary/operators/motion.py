"""Motion between consecutive frames, from measures and landmarks kept in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def differences(frames: DataFrame, keys: list[str], order: str, measures: list[str]) -> DataFrame:
    """frames with d_<measure>: how far each measure lies from the frame before; null on the first and where one is missing."""
    w = consecutive(keys, order)
    return frames.withColumns({f"d_{m}": F.abs(F.col(m) - F.lag(m).over(w)) for m in measures})


def euclid(*deltas: Column) -> Column:
    """The length of a vector of any number of dimensions."""
    return F.sqrt(sum((d * d for d in deltas[1:]), deltas[0] * deltas[0]))


def displacement(frames: DataFrame, keys: list[str], order: str, x: str, y: str, width: str, height: str, name: str = "displacement") -> DataFrame:
    """frames with the way of a point since the frame before, as a share of the frame's longer side.

    Null on a clip's first frame and where the point is missing in either.
    """
    w = consecutive(keys, order)
    return frames.withColumn(name, euclid(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / F.greatest(width, height))


def distance_to_box(x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The distance of a point from a box; 0 inside, null for a missing point."""
    outside = lambda v, lo, hi: F.when(v.isNotNull(), F.greatest(lo - v, v - hi, F.lit(0.0)))
    return euclid(outside(x, left, right), outside(y, top, bottom))
