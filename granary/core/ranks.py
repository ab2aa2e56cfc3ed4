"""Ranks over many rows, with no task ordering more than a piece of them."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pieces(splitters: Column, value: Column) -> Column:
    """The number of splitters below value."""
    return F.size(F.filter(splitters, lambda s: s < value))


def numbered(df: DataFrame, key: str, name: str, pieces: int = 256) -> DataFrame:
    """df, whose keys are distinct and not null, with their rank from 1 in a column.

    A sample of keys, drawn by hash, gives up to `pieces` ranges; each is ordered by itself and starts after the rows of
    those before it. To the driver come the sample and a count for each range.
    """
    n = df.count()
    share = min(1.0, 32 * pieces / max(n, 1))
    drawn = sorted(r[0] for r in df.filter(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < int(share * (1 << 30))).select(key).collect())
    cuts = sorted({drawn[k * len(drawn) // pieces] for k in range(1, pieces)}) if drawn else []
    dealt = df.withColumn("_piece", _pieces(F.lit(cuts), F.col(key)) if cuts else F.lit(0))
    held = {r["_piece"]: r["count"] for r in dealt.groupBy("_piece").count().collect()}
    before = dict(zip(sorted(held), accumulate([0, *(held[k] for k in sorted(held))]), strict=False))
    start = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return dealt.withColumn(name, start[F.col("_piece").cast("long")] + F.row_number().over(Window.partitionBy("_piece").orderBy(key))).drop("_piece")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null meeting null."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(right, met).drop(*[f"_right_{k}" for k in keys])


def at_ranks(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], pieces: int = 64) -> DataFrame:
    """For each key the values at places, which are columns over total, the key's rows, and held, those with a value, that count from 0.

    Nulls come last. Equal values shrink to one row with their number; splitters cut each key into pieces, each ordered by
    itself. The plan finds the splitters more than once, so they must not depend on the order in which tasks finish: they
    come from a sample of distinct values, the first by hash in each of 32 * pieces classes of hashes.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    hashed = F.xxhash64(F.lit(7), value)
    drawn = counted.groupBy(*keys, F.pmod(hashed, F.lit(32 * pieces)).alias("_class")).agg(
        F.min(F.struct(hashed.alias("hash"), F.col(value).alias("value")))["value"].alias("_drawn"), F.sum("_n").alias("total"), F.sum(F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)).alias("held"),
    )
    drawn = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list("_drawn")).alias("_drawn"), F.sum("total").alias("total"), F.sum("held").alias("held"))
    step = F.ceil(F.size("_drawn") / pieces)
    cuts = drawn.withColumn("_cuts", F.filter("_drawn", lambda _, i: (i > 0) & (i % step == 0))).drop("_drawn")
    piece = F.when(F.col(value).isNull(), F.lit(pieces)).otherwise(_pieces(F.col("_cuts"), F.col(value)))
    dealt = null_safe_join(counted, cuts, keys).withColumn("_piece", piece).drop("_cuts")
    sums = dealt.groupBy(*keys, "_piece").agg(F.sum("_n").alias("_own"))
    before = sums.withColumn("_before", F.sum("_own").over(Window.partitionBy(*keys).orderBy("_piece")) - F.col("_own")).drop("_own")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_piece").orderBy(value))
    placed = null_safe_join(dealt.withColumn("_end", upto), before, [*keys, "_piece"]).withColumn("_end", F.col("_end") + F.col("_before"))
    here = lambda at: (at < F.col("_end")) & (at >= F.col("_end") - F.col("_n"))
    return placed.groupBy(*keys).agg(F.first("total").alias("n"), *[F.max(F.when(here(at), F.col(value))).alias(name) for name, at in places.items()])
