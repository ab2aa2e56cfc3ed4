"""Segment names, ids, and roll-ups from clips to sessions, persons and the dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.core.ranks import numbered

SEGMENT = r"^([^_]+)_VID_(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})_(\d{2})_(\d+)$"
MODALITIES = ("video", "usage", "heart", "questionnaire")


def parse_segments(df: DataFrame, name: str = "name") -> DataFrame:
    """df with the parts of its segment names; parts are null and valid is false where the name does not fit."""
    part = lambda k: F.nullif(F.regexp_extract(name, SEGMENT, k), F.lit(""))
    return df.withColumns(
        {
            "valid": F.coalesce(F.col(name).rlike(SEGMENT), F.lit(False)), "person_raw": part(1), "session_key": F.when(F.col(name).rlike(SEGMENT), F.regexp_replace(name, "_[^_]+$", "")),
            "captured_on": F.concat_ws("-", part(2), part(3), part(4)), "captured_at": F.concat_ws(":", part(5), part(6), part(7)), "clip_raw": part(8), "clip_index": part(8).cast("int"),
        }
    )


def with_uids(df: DataFrame, scan: str = "name") -> DataFrame:
    """person_uid by rank of raw id, session_uid by first appearance in the person's scan, clip_uid by place in it.

    The dense number of persons comes from their distinct ids alone, ordered in ranges.
    """
    people = numbered(df.select("person_raw").filter("person_raw IS NOT NULL").distinct(), "person_raw", "_nth").select("person_raw", F.format_string("internal_p%06d", "_nth").alias("person_uid"))
    df = df.join(people, "person_raw")
    person = Window.partitionBy("person_raw")
    first = F.min(scan).over(Window.partitionBy("person_raw", "session_key"))
    df = df.withColumn("_first", first).withColumn("_nth", F.dense_rank().over(person.orderBy("_first"))).withColumn("_clip", F.row_number().over(person.orderBy(scan)))
    return df.withColumn("session_uid", F.concat("person_uid", F.format_string("_s%04d", "_nth"))).withColumn("clip_uid", F.concat("person_uid", F.format_string("_c%06d", "_clip"))).drop("_first", "_nth", "_clip")


def completeness(clips: DataFrame) -> DataFrame:
    """What modalities each person has, by clips; an unknown emptiness counts as not empty."""
    full = lambda m: F.col(f"{m}_available") & ~F.coalesce(F.col(f"{m}_empty"), F.lit(False))
    return clips.groupBy("person").agg(
        F.count(F.lit(1)).alias("n_clips"), F.count_if("video_available").alias("n_video"), F.coalesce(F.sum(F.when(F.col("usage_available"), F.col("usage_records"))), F.lit(0)).alias("n_usage_records"),
        F.count_if(full("usage")).alias("n_usage"), F.count_if(full("heart")).alias("n_heart"), F.bool_or(full("questionnaire")).alias("has_questionnaire"),
    )


def questionnaire_consistency(clips: DataFrame) -> DataFrame:
    """Whether a person's questionnaire copies agree; the representative is the first that is not empty, else the first."""
    here = F.col("questionnaire_available")
    full = here & ~F.coalesce(F.col("questionnaire_empty"), F.lit(False))
    digest = F.when(here, F.col("questionnaire_sha"))
    df = clips.groupBy("person").agg(
        F.count_distinct(digest).alias("n_payloads"), F.count_if(full).alias("n_full"), F.count_if(here).alias("n_here"),
        F.min_by(F.when(here, F.col("questionnaire_sha")), F.when(here, F.struct((~full).alias("e"), F.col("clip")))).alias("representative"),
    )
    return df.select("person", F.when(F.col("n_payloads") > 0, F.col("n_payloads")).alias("n_payloads"), F.when(F.col("n_payloads") > 0, F.col("n_payloads") <= 1).alias("same"), "n_full", (F.col("n_here") - F.col("n_full")).alias("n_empty"), "representative")


def data_quality(clips: DataFrame) -> DataFrame:
    """Missing and empty counts by modality, over all clips."""
    each = [F.struct(F.lit(m).alias("modality"), F.col(f"{m}_available").alias("here"), F.coalesce(F.col(f"{m}_empty"), F.lit(False)).alias("empty")) for m in MODALITIES]
    long = clips.select(F.inline(F.array(*each)))
    return long.groupBy("modality").agg(F.count(F.lit(1)).alias("n_clips"), F.count_if(~F.col("here")).alias("n_missing"), F.count_if(F.col("here") & F.col("empty")).alias("n_empty"))


def person_manifest(clips: DataFrame) -> DataFrame:
    """Persons with their sessions and clips nested, in order."""
    sessions = clips.groupBy("person", "session_uid").agg(F.array_sort(F.collect_list(F.struct("clip", "clip_uid", "name"))).alias("clips"))
    return sessions.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("session_uid", F.size("clips").alias("clip_count"), "clips"))).alias("sessions"))


def flatten_clips(people: DataFrame) -> DataFrame:
    """Clips of nested persons in order: the inverse of person_manifest."""
    df = people.select("person", F.posexplode("sessions").alias("session_pos", "s"))
    return df.select("person", "s.session_uid", "session_pos", F.posexplode("s.clips").alias("clip_pos", "c")).select("person", "session_uid", "session_pos", "clip_pos", "c.*")


def merge_plan(source: DataFrame, target: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """What a merge of two listings does with each path: add, keep, duplicate (equal sizes) or conflict."""
    s, t = source.select(path, F.col(size).alias("source_size")), target.select(path, F.col(size).alias("target_size"))
    action = F.when(F.col("target_size").isNull(), "add").when(F.col("source_size").isNull(), "keep").when(F.col("source_size") == F.col("target_size"), "duplicate").otherwise("conflict")
    return s.join(t, path, "full_outer").withColumn("action", action)
