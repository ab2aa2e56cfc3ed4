"""Even sampling and the relative timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def even_indices(n: Column, k: int) -> Column:
    """0-based indices of k evenly spaced of n items (array<long>): all if there are no more or k <= 0; the first if k is 1."""
    every = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    if k <= 0:
        return F.when(n > 0, every).otherwise(F.array().cast("array<long>"))
    if k == 1:
        return F.when(n > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(k - 1)).cast("long"))
    return F.when(n <= 0, F.array().cast("array<long>")).when(n <= k, every).otherwise(spaced)


def frame_indices(n: Column, samples: int) -> Column:
    """Indices of `samples` frames from 10 to 90 per cent of n frames, none beyond the last."""
    first, last = F.floor(n * 0.1), F.greatest(F.floor(n * 0.1), F.floor(n * 0.9))
    step = (last - first) / F.lit(max(samples - 1, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.least(n - 1, F.rint(first + i * step)).cast("long"))


def spread_indices(n: Column, samples: int) -> Column:
    """Distinct indices of about `samples` of n frames, evenly from the first to the last, as the first generation drew them."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(max(samples, 1) - 1)), lambda i: F.rint(i * (n - 1) / F.lit(max(samples - 1, 1))).cast("long"))
    return F.when((n <= 0) | n.isNull() | F.lit(samples <= 0), F.array().cast("array<long>")).otherwise(F.array_sort(F.array_distinct(spaced)))


def with_start_offset(df: DataFrame, keys: list[str], order: str, duration: str, name: str = "start_offset") -> DataFrame:
    """Sum of the durations before each row; null durations count as 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.coalesce(F.col(duration), F.lit(0.0))).over(w), F.lit(0.0)))


def relative_period(start: Column, duration: Column) -> Column:
    """mm:ss - mm:ss with both ends rounded to half minutes, half to even; null without a duration."""
    half = lambda x: (F.rint(x / 30) * 30).cast("long")
    show = lambda x: F.format_string("%02d:%02d", F.floor(x / 60), x % 60)
    return F.when(duration.isNotNull(), F.concat(show(half(start)), F.lit(" - "), show(half(start + duration))))
