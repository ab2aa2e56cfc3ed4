"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names for all executors; where it is unset, a new one, on a local master only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="granary-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, rows_a_part: int = 20_000, at_most: int | None = None) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows, in partitions of about rows_a_part rows where it has more of them than that.

    at_most: what its rows cannot exceed, for as few partitions from the start. Narrow tables keep few partitions so,
    and each later shuffle few files, however many partitions the input had.
    """
    parts = lambda n: max(1, -(-n // rows_a_part))
    df = cut(df if at_most is None else df.coalesce(parts(at_most)))
    n = df.count()
    return df.coalesce(parts(n)), n


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: Column, total: int) -> DataFrame:
    """rows.join(groups, key), where groups has one row for each key and n counts the rows that hold it, total in all.

    Groups of more than a thousandth of the rows, of which there are less than 1000, go to every task; all others
    meet their rows by a shuffle, where none of them is large. groups is read more than once and should be cut.
    """
    large = groups.filter(n * 1000 > total)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.filter(n * 1000 <= total), key)
    return rows.join(F.broadcast(large), key).unionByName(rest)


def likely_in(rows: DataFrame, members: DataFrame, n: int, key: str, most_bits: int = 1 << 26) -> DataFrame:
    """The rows whose key is among the n of members, and few others: as many as share a bit with them by chance.

    Hashed keys set bits, 16 for each member but most_bits at most; their words of 64 bits, 2 ** 20 rows at most, go to
    every task. So most rows without a partner are left out before they are shuffled to be joined (by an inner join: a
    left semi join would be moved below this one).
    """
    bits = min(most_bits, 1 << max(10, (16 * n).bit_length()))
    word, bit, mask = (free_name(rows, x) for x in ("_word", "_bit", "_mask"))
    hashed = lambda df: df.withColumn(bit, F.pmod(F.xxhash64(F.lit(53), key), F.lit(bits))).withColumn(word, F.shiftright(bit, 6))
    shifted = F.expr(f"shiftleft(1L, cast(`{bit}` % 64 as int))")
    words = hashed(members.select(key)).groupBy(word).agg(F.bit_or(shifted).alias(mask))
    return hashed(rows).join(F.broadcast(words), word).filter(F.col(mask).bitwiseAND(shifted) != 0).select(*[f"`{c}`" for c in rows.columns])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def windows(text: str, size: int = 1 << 20) -> Iterator[str]:
    """text in pieces of about size characters, cut at spaces only."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]
