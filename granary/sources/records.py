"""Clip, label, prediction and payload tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.core import rules
from granary.sources.events import ordered_events


def clips(events: DataFrame) -> DataFrame:
    """One row for each twelve events of a user: a segment name, size, duration and what payloads it has."""
    df = ordered_events(events).withColumn("clip", F.floor(F.col("ord") / 12))
    df = df.groupBy("person", "clip").agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("size_bytes"), F.sum("k").alias("k"), F.min("ts").alias("ts"))
    named = F.format_string("%06d_VID_%s_%03d", F.col("person"), F.date_format("ts", "yyyy_MM_dd_HH_mm_ss"), F.col("clip"))
    sha = F.sha2(F.concat_ws("-", F.col("person").cast("string"), F.when(F.col("person") % 3 == 0, F.col("clip") % 2).otherwise(0).cast("string")), 256)
    return df.select(
        "person", "clip", named.alias("name"), "n_frames", "size_bytes", F.when(F.col("k") % 7 != 0, F.col("k").cast("double")).alias("seconds"),
        (F.col("k") % 5 != 4).alias("video_available"), (F.col("size_bytes") % 11 == 0).alias("video_empty"), (F.col("k") % 3 != 0).alias("usage_available"), F.when(F.col("k") % 4 != 0, F.col("k") % 6 == 1).alias("usage_empty"),
        F.col("n_frames").alias("usage_records"), (F.col("k") % 4 != 1).alias("heart_available"), (F.col("k") % 8 == 2).alias("heart_empty"), (F.col("k") % 6 != 5).alias("questionnaire_available"), (F.col("clip") % 3 == 0).alias("questionnaire_empty"), sha.alias("questionnaire_sha"),
    )


def label_sheet(events: DataFrame) -> DataFrame:
    """Annotator rows: most name a clip in one of two columns, some a second clip, every fourth a person only."""
    df = clips(events).filter("clip % 2 = 0")
    other = F.format_string("archive/%06d_VID_2000_01_01_00_00_00_%03d", F.col("person"), F.col("clip"))
    level = F.expr("CASE k4 WHEN 0 THEN 'no_observed_risk' WHEN 1 THEN 'mild_risk' WHEN 2 THEN 'moderate_risk' ELSE 'high_risk' END")
    df = df.withColumn("vote", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("k4", (F.col("size_bytes") + F.col("vote") * F.col("n_frames")) % 4)
    by_person = F.col("person") % 4 == 0
    return df.select(
        (F.col("person") * 1000 + F.col("clip") * 3 + F.col("vote") + 2).alias("row_index"), F.when(~by_person, F.concat(F.lit("/videos/"), "name", F.lit("/clip.mp4"))).alias("video_path"),
        F.when(F.col("vote") == 1, F.concat_ws(" ", other, F.when(~by_person, F.col("name")))).alias("plot_path"), F.when(by_person, F.col("person")).alias("participant"), level.alias("risk_level"),
    )


def prediction_log(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One to three attempts for each document, with invalid levels and errors among them."""
    df = documents.join(labels, "doc_id", "left").withColumn("attempt", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    names = F.array(*map(F.lit, [*rules.RISK_LABELS, "severe"]))
    at = ((F.col("n_chars") + F.col("attempt") * 7 + F.col("doc_id")) % 6).cast("int")
    return df.select(
        F.col("doc_id").alias("sample_id"), (F.col("doc_id") * 3 + F.col("attempt")).alias("seq"), F.expr(rules.LABEL_OF).alias("target"), F.get(names, at).alias("predicted"),
        F.when((F.col("doc_id") + F.col("attempt")) % 5 == 0, "timeout").alias("error"), "source", "lang", F.expr(rules.labels("n_chars", [("< 500", "short"), ("< 2000", "medium")], "long")).alias("length_bin"),
    )


def daily_payloads(events: DataFrame) -> DataFrame:
    """Each user's events as lists of heart-rate and usage items in order; every tenth bpm is missing."""
    df = ordered_events(events)
    heart = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.when(F.col("k") % 10 != 0, F.col("value")).alias("bpm"))
    used = F.rint(F.col("value") * 100).cast("long").alias("total_time")
    return df.groupBy("person").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", heart.alias("h")))), lambda x: x["h"]).alias("heart"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(used).alias("u")))), lambda x: x["u"]).alias("used"),
    )
