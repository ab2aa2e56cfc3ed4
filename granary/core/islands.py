"""Runs and islands of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_islands(df: DataFrame, keys: list[str], order: str, same: list[str], name: str = "island") -> DataFrame:
    """Number of the run of rows that agree in the columns same with the row before; null agrees with null."""
    w = Window.partitionBy(*keys).orderBy(order)
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.lag(c).over(w))
    new = F.when((F.row_number().over(w) > 1) & alike, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def longest_runs(df: DataFrame, keys: list[str], order: str, flags: dict[str, Column]) -> DataFrame:
    """For each key the length of the longest run of rows where a flag holds, 0 where it never does."""
    w = Window.partitionBy(*keys).orderBy(order)
    held = df.select(*keys, order, *[F.coalesce(c, F.lit(False)).alias(f"_f_{n}") for n, c in flags.items()])
    since = {f"_g_{n}": F.sum((~F.col(f"_f_{n}")).cast("long")).over(w) for n in flags}
    held = held.withColumns(since)
    runs = {f"_r_{n}": F.sum(F.col(f"_f_{n}").cast("long")).over(Window.partitionBy(*keys, f"_g_{n}")) for n in flags}
    return held.withColumns(runs).groupBy(*keys).agg(*[F.max(f"_r_{n}").alias(n) for n in flags])


def gap_tolerant_runs(df: DataFrame, keys: list[str], order: str, active: Column, gap: int, least: int, name: str = "in_run") -> DataFrame:
    """df with a flag on active rows of runs of at least `least` active rows, between which at most gap rows are inactive."""
    w = Window.partitionBy(*keys, "_on").orderBy(order)
    apart = F.col("_on") & (F.coalesce(F.col(order) - F.lag(order).over(w) - 1, F.lit(gap + 1)) > gap)
    df = df.withColumn("_on", F.coalesce(active, F.lit(False))).withColumn("_run", F.sum(apart.cast("long")).over(w))
    run = Window.partitionBy(*keys, "_on", "_run")
    return df.withColumn(name, F.col("_on") & (F.count(F.lit(1)).over(run) >= least)).drop("_on", "_run")


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones, the one that comes first in order."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_at"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_at"))).alias(name))


def counter_text(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Counts by value of each key as sorted text `value=n;…`; null counts as <blank>."""
    counted = df.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("<blank>")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "_v", F.col("_n").cast("string"))))
    return counted.groupBy(*keys).agg(F.array_join(entries, ";").alias(name))


def modes_in_order(values: Column) -> Column:
    """The distinct values of a short array as structs (n, before, value): how often each occurs and minus its place among
    them; the greatest struct is the most frequent value, of equally frequent ones the first."""
    distinct = F.array_distinct(values)
    return F.transform(distinct, lambda v, i: F.struct(F.size(F.filter(values, lambda x: x.eqNullSafe(v))).alias("n"), (-i).alias("before"), v.alias("value")))


def mode_in_order(order: Column, value: Column) -> Column:
    """An aggregate: the most frequent value of a group of few rows; of equally frequent ones, the first in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.array_max(modes_in_order(listed))["value"]


def run_lengths(df: DataFrame, keys: list[str], order: str, flags: dict[str, Column]) -> DataFrame:
    """df with the length of the run of flagged rows in which each row lies, 0 on rows that are not flagged."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumns({f"_f_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    df = df.withColumns({f"_g_{n}": F.sum((~F.col(f"_f_{n}")).cast("long")).over(w) for n in flags})
    df = df.withColumns({n: F.sum(F.col(f"_f_{n}").cast("long")).over(Window.partitionBy(*keys, f"_g_{n}")) for n in flags})
    return df.drop(*[f"_{k}_{n}" for n in flags for k in "fg"])
