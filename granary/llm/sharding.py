"""Sharding by sampled splitters: size-weighted quantile ranges of a hashed key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, free_name


def range_of(splitters: np.ndarray, h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Number of the splitters (rows h, i in rising order) that are at most (h, i), for each pair."""
    lo, hi = np.searchsorted(splitters[:, 0], h, "left"), np.searchsorted(splitters[:, 0], h, "right")
    for k in np.unique(lo[lo < hi]):
        at = (lo == k) & (lo < hi)
        lo[at] = k + np.searchsorted(splitters[k : hi[at][0], 1], i[at], "right")
    return lo


def _splitters(sample: list[tuple[int, int, float]], pieces: int) -> set[tuple[int, int]]:
    """Keys that cut the sample (h, i, weight) into pieces of equal weight."""
    if not sample:
        return set()
    rows = sorted(sample)
    weight = np.cumsum([r[2] for r in rows])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, pieces) / pieces)
    return {rows[k][:2] for k in at}


def _sample(keys: DataFrame, total: int, points: int, seed: int) -> list[tuple[int, int, float]]:
    """About `points` keys at most, drawn in proportion to size; the weight of one that is sure to be drawn is its size."""
    chance = F.col("size") * (points / max(total, 1))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "h", "i"), F.lit(1 << 40)) / float(1 << 40) < chance
    return [(r.h, r.i, r.w) for r in keys.filter(drawn).select("h", "i", F.greatest(chance, F.lit(1.0)).alias("w")).collect()]


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, points: int = 32, rounds: int = 4, seed: int = 29) -> DataFrame:
    """docs with size, shard and slot (columns of these names are replaced); shards have nearly equal bytes.

    size: UTF-8 bytes of the text (null: none) plus 1. The key is (hash of the text, hash of the id and place), so
    equal texts are neighbours. Key samples drawn by size give splitters for `ranges` ranges (64 a shard, more where
    a range would exceed 64 MB, 65536 at most); a range whose bytes exceed twice the mean is
    subdivided by splitters of a sample of its own, for up to `rounds` rounds or until such ranges hold one key.
    Ranges follow each other through the shards.

    Equal texts share a shard: a group over a shard's end goes where its middle lies. Only of a group of more than
    a 16th of a shard's bytes, of which there are less than 16 a shard, each row goes where its own middle lies. So a
    shard's bytes differ from the mean by less than a 16th of it, or than one row's. slot counts a shard's rows from 0
    in key order. Repeated rows have keys of their own; null ids and texts are keys as any other; a very long text is
    one row, and its shard is the longer for it. An empty table gives an empty result.

    What comes to the driver: samples of about `points` keys a range and, for each range, a sum; their number
    is bounded. Rows are moved once, by range. docs must yield the same rows in the same order when read again.
    """
    row, h, i, at, r, before, earlier, rank, own = (free_name(docs, x) for x in ("_row", "_h", "_i", "_range", "_r", "_bytes", "_rows", "_rank", "_own"))
    columns = [f"`{c}`" for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    keyed = docs.withColumns({row: F.monotonically_increasing_id(), h: F.coalesce(F.xxhash64(text_col), F.lit(0)), "size": size}).withColumn(i, F.xxhash64(F.col(id_col).cast("string"), row))
    keys = cut(keyed.select("size", F.col(h).alias("h"), F.col(i).alias("i")))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = ranges or max(64 * n_shards, min(65536, total >> 26))
    large = np.array(sorted(x["h"] for x in keys.groupBy("h").agg(F.sum("size").alias("n")).filter(F.col("n") * 16 * n_shards > total).collect()), np.int64)
    cuts = _splitters(_sample(keys, total, ranges * points, seed), ranges)

    for k in range(rounds + 1):
        known = _whole(cuts, large)
        found = keys.groupBy(_range_udf(known)("h", "i").alias("r")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        held = {x["r"]: (x["size"], x["n"]) for x in found.collect()}
        over = {r: s for r, (s, n) in held.items() if s > 2 * total / ranges and n > 1}
        if not over or k == rounds:
            break
        inside = keys.withColumn("r", _range_udf(known)("h", "i")).filter(F.col("r").isin(list(over)))
        drawn: dict[int, list] = {}
        for x in _sample(inside, sum(over.values()), points * len(over), seed + k + 1):
            drawn.setdefault(int(range_of(known, np.array([x[0]]), np.array([x[1]]))[0]), []).append(x)
        more = set().union(*(_splitters(x, max(2, round(2 * over[r] * ranges / max(total, 1)))) for r, x in drawn.items()))
        cuts |= more
        if len(_whole(cuts, large)) == len(known):
            break

    starts, bytes_before, rows_before = [], 0, 0
    for k in sorted(held):
        starts.append((k, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + held[k][0], rows_before + held[k][1]
    start = F.broadcast(docs.sparkSession.createDataFrame(starts, f"`{r}` int, `{before}` long, `{earlier}` long"))  # a row for each range, whose number is bounded
    shared = _among_udf(large)

    def placed(df: DataFrame, h: str, i: str) -> DataFrame:
        """df with its shard and its rank among all rows."""
        w = Window.partitionBy(at)
        upto = lambda *key: F.sum("size").over(w.orderBy(*key))
        df = df.withColumn(at, _range_udf(known)(h, i)).join(start, F.col(at) == F.col(r)).withColumn(own, shared(h))
        middle = F.when(F.col(own), 2 * upto(h, i) - F.col("size")).otherwise(2 * upto(h) - F.sum("size").over(Window.partitionBy(at, h)))
        df = df.withColumn(own, 2 * F.col(before) + middle).withColumn(rank, F.col(earlier) + F.row_number().over(w.orderBy(h, i)) - 1)
        return df.withColumn("shard", F.expr(f"cast(least({n_shards - 1}, `{own}` * {n_shards} div {2 * max(total, 1)}) as int)"))

    firsts = placed(keys, "h", "i").groupBy("shard").agg(F.min(rank).alias("n")).collect()
    first_of = F.create_map(*[F.lit(x) for f in firsts for x in (f["shard"], f["n"])]) if firsts else F.create_map(F.lit(0), F.lit(0).cast("long"))
    return placed(keyed, h, i).select(*columns, "size", "shard", (F.col(rank) - first_of[F.col("shard")]).cast("long").alias("slot"))


def _whole(cuts: set[tuple[int, int]], large: np.ndarray) -> np.ndarray:
    """Splitters in rising order; those within a text's hash are moved to its first key, unless the hash is large."""
    rows = np.array(sorted(cuts), dtype=np.int64).reshape(-1, 2)
    rows[~np.isin(rows[:, 0], large), 1] = np.iinfo(np.int64).min
    return np.unique(rows, axis=0)


def _range_udf(splitters: np.ndarray):
    @F.pandas_udf("int")
    def find(h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(range_of(splitters, h.to_numpy(), i.to_numpy()).astype(np.int32))

    return find


def _among_udf(hashes: np.ndarray):
    @F.pandas_udf("boolean")
    def find(h: pd.Series) -> pd.Series:
        return pd.Series(np.isin(h.to_numpy(), hashes))

    return find


def write_shards(sharded: DataFrame, path: str) -> None:
    """Sharded rows as one folder of Parquet files for each shard."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
