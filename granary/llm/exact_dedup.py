"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, free_name, join_groups, lower_ascii

#: Above every place of a row, as there are less than 2 ** 29 partitions.
PLACES = Decimal(2**62)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, with_place: bool = False) -> DataFrame:
    """Class, size and survivor of every row of docs.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest id stays; of repeated rows that share that id the last one does. A null id loses to
    any other. Returns the columns id_col, keep_id, group_size, kept, text_sha256; further columns of docs are not
    read; with_place adds _uid, the place of the row in docs. An empty table gives an empty result.

    Stages, each of which groups by the digest and by the whole normalised text, so that two texts never
    merge on a digest alone:

    1. locally: the map side of the salted aggregation leaves one row per text and input partition;
    2. salted: those rows meet by (digest, text, salt), the salt being drawn from the input partition, so one
       text that fills a third of the table is combined by `salts` tasks;
    3. globally: at most `salts` winners of each text meet.

    Rows then get their class back by a join of digests, lengths and a second hash; no text takes part in it. Classes
    that hold more than a thousandth of the rows reach them without a shuffle. docs must yield the same rows in the same order when
    read again, as tables and files do.
    """
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).withColumns(
        {"_uid": F.monotonically_increasing_id(), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts)), "_digest": F.unhex(F.sha2("_norm", 256))}
    )
    # id, null below all, then place as one number: unlike a struct it can be aggregated by hashing
    rank = (F.coalesce(F.col("_id").cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0))).cast("decimal(20,0)") * F.lit(PLACES) + F.col("_uid").cast("decimal(20,0)")).cast("decimal(38,0)")
    salted = rows.groupBy("_digest", "_norm", "_salt").agg(F.max("_id").alias("_keep"), F.max(rank).alias("_rank"), F.count(F.lit(1)).alias("_n"))
    key = F.struct("_digest", F.length("_norm").alias("_length"), F.xxhash64("_norm").alias("_second")).alias("_key")
    winners = cut(
        salted.groupBy("_digest", "_norm")
        .agg(F.max("_keep").alias("keep_id"), F.max("_rank").alias("_rank"), F.sum("_n").alias("group_size"))
        .select(key, "keep_id", (F.col("_rank") % F.lit(PLACES)).cast("long").alias("_keep_uid"), "group_size")
    )
    total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    narrow = cut(rows.select("_id", "_uid", key))
    return join_groups(narrow, winners, "_key", F.col("group_size"), total).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_uid") == F.col("_keep_uid")).alias("kept"),
        F.lower(F.hex("_key._digest")).alias("text_sha256"),
        *(["_uid"] if with_place else []),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; every column, of whatever name, stays as it was.

    Rows find their decision by their place in docs, which spreads evenly however large a group of copies is.
    """
    decided = exact_dedup(docs, id_col, text_col, with_place=True)
    place = free_name(docs, "_place")
    kept = decided.filter("kept").select(F.col("_uid").alias(place))
    return docs.withColumn(place, F.monotonically_increasing_id()).join(kept, place, "left_semi").select(*[f"`{c}`" for c in docs.columns])
