"""Annotator rows joined to clips and persons, and their majority votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: a segment name begins after a slash, backslash or white space.
TOKEN = r"([^/\\\s]+_VID_\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}_\d+)"


def risk_level(concern: Column, grade: Column) -> Column:
    """Risk label of a row of the label sheet from whether there is concern and its grade (fixed values of the sheet)."""
    concern, grade = (F.regexp_replace(c, r"^\s+|\s+$", "") for c in (concern, grade))
    graded = {"轻度": "mild_risk", "中度": "moderate_risk", "重度": "high_risk"}
    out = F.when(concern == "否", "no_observed_risk")
    for k, v in graded.items():
        out = out.when((concern == "是") & (grade == k), v)
    return out.otherwise("insufficient_evidence")


def token_index(sheet: DataFrame, columns: list[str], row: str = "row_index") -> DataFrame:
    """Rows (token, row_index): the distinct segment names anywhere in the path-like columns of a label row."""
    searched = F.concat_ws(" ", *columns)
    return sheet.select(row, F.explode(F.array_distinct(F.regexp_extract_all(searched, F.lit(TOKEN), 1))).alias("token"))


def clip_labels(clips: DataFrame, sheet: DataFrame, columns: list[str], label: str = "risk_level") -> DataFrame:
    """Every clip with each label row that names it, once; clips that no row names have nulls."""
    index = token_index(sheet, columns).join(sheet.select("row_index", label), "row_index")
    return clips.join(index, clips["name"] == index["token"], "left").dropDuplicates(["person", "clip", "row_index"])


def majority(rows: DataFrame, keys: list[str], label: str = "risk_level") -> DataFrame:
    """Majority label of each key; where the two most frequent tie, insufficient_evidence. Null labels do not vote."""
    counted = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    votes = F.sort_array(F.collect_list(F.struct("_n", label)), asc=False)
    df = counted.groupBy(*keys).agg(votes.alias("_v"), F.sum("_n").alias("n_rows"))
    tie = (F.size("_v") > 1) & (F.get("_v", F.lit(0))["_n"] == F.get("_v", F.lit(1))["_n"])
    counts = F.array_join(F.array_sort(F.transform("_v", lambda x: F.concat_ws("=", x[label], x["_n"].cast("string")))), ";")
    return df.select(*keys, "n_rows", tie.alias("has_tie"), F.when(tie, "insufficient_evidence").otherwise(F.get("_v", F.lit(0))[label]).alias("majority"), counts.alias("counts"))


def person_labels(people: DataFrame, matched: DataFrame, sheet: DataFrame) -> DataFrame:
    """Label rows of each person: those of its clips, or, only where there is none, those that name the person itself."""
    own = matched.filter(F.col("row_index").isNotNull()).select("person", "row_index", "risk_level").dropDuplicates(["person", "row_index"])
    rest = people.join(own.select("person").distinct(), "person", "left_anti")
    named = rest.join(sheet.select("participant", "row_index", "risk_level"), F.col("person") == F.col("participant")).select("person", "row_index", "risk_level")
    return own.withColumn("method", F.lit("clip_matches")).unionByName(named.withColumn("method", F.lit("person_fallback")))


def coverage(matched: DataFrame) -> DataFrame:
    """Clips and labelled clips of each person."""
    return matched.groupBy("person").agg(F.count_distinct("clip").alias("n_clips"), F.count_distinct(F.when(F.col("row_index").isNotNull(), F.col("clip"))).alias("n_labeled"))
